import pytest
from pyspark.sql import functions as F

from lotewise.functions import classify as C
from lotewise.functions import text as T


def run(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(f(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


def test_parse_brl(spark):
    cases = {"R$ 1.600,00": 1600.0, "1.400,00": 1400.0, "1902.38": 1902.38, "40.00 m²": 40.0, "1.000m²": 1000.0, "R$ 1.234.567,89": 1234567.89, "1,234.56": 1234.56, "-5": -5.0, "R$ 50": 50.0}
    assert run(spark, list(cases), T.parse_brl) == list(cases.values())
    assert run(spark, ["R$ -", "--", "$undefined", "Sob consulta", "", None, "x"], T.parse_brl) == [None] * 7


def test_parse_int_and_coord(spark):
    assert run(spark, ["3", "2.5", "abc", "", None, "-1", "1.200", "1-2"], T.parse_int) == [3, 3, 0, None, None, None, 1, None]
    assert run(spark, ["-22.88", "0", "", None, "x"], T.parse_coord) == [-22.88, None, None, None, None]


def test_phone(spark):
    got = run(spark, ["14 99999-1234", "014 3882-1234", "5514999991234", "+55 14 3882-1234", "55999991234", "12345", None], T.parse_phone)
    assert [g and (g.exibicao, g.e164, g.celular) for g in got] == [
        ("(14) 99999-1234", "5514999991234", True),
        ("(14) 3882-1234", "551438821234", False),
        ("(14) 99999-1234", "5514999991234", True),
        ("(14) 3882-1234", "551438821234", False),
        ("(55) 99999-1234", "5555999991234", True),
        None,
        None,
    ]
    assert run(spark, ["3882-1234"], lambda c: T.parse_phone(c, "14"))[0].digitos == "1438821234"


def test_contacts(spark):
    def contacts(c):
        many = F.array(T.make_contact("corretor", F.lit("Ana"), c), T.make_contact("anunciante", F.lit(None).cast("string"), c, email=F.lit("a@b.c")), T.make_contact("corretor", F.lit("Bia"), F.lit(None).cast("string"), creci=F.lit("9")), T.make_contact("corretor", F.lit("Ninguém"), F.lit(None).cast("string")))
        return T.dedupe_contacts(many)

    got = run(spark, ["14 99999-0001", "14 3882-0001"], contacts)
    assert [(c.nome, c.papel, c.whatsapp, c.email) for c in got[0]] == [("Ana", "corretor", "5514999990001", "a@b.c"), ("Bia", "corretor", None, None)]
    assert got[1][0].whatsapp is None and got[1][0].telefone == "(14) 3882-0001"


@pytest.mark.parametrize(
    ("labels", "kind"),
    [
        (("Apartamentos", "Kitnet"), "kitnet"), (("STUDIO_APARTMENT", None), "kitnet"), (("Casas", "Condomínio"), "casa_condominio"), (("casa comercial", None), "comercial"),
        (("TWO_STORY_HOUSE", None), "sobrado"), (("Apartamento residencial", None), "casa"), (("Chácara", None), "rural"), (("xyz", None), "outro"), (("Apartamentos", "Flat"), "flat"), (("lote", ""), "terreno"),
    ],
)
def test_map_type(spark, labels, kind):
    df = spark.createDataFrame([labels], "a string, b string")
    assert df.select(C.map_type(F.col("a"), F.col("b"))).first()[0] == kind


def test_refine_and_inference(spark):
    df = spark.createDataFrame([("apartamento", "KITNET no centro"), ("casa", "Sala ampla, casa em condomínio"), ("outro", "Apto novo"), ("terreno", "casa")], "t string, s string")
    assert [r[0] for r in df.select(C.refine_type(F.col("t"), F.col("s"))).collect()] == ["kitnet", "casa_condominio", "apartamento", "terreno"]
    assert run(spark, ["não mobiliado", "Semi mobiliado", "nada", None, "com móveis"], C.infer_furnished) == [False, True, None, None, True]
    assert run(spark, ["Não aceita animais", "aceita pets", "pet friendly", "sem pets", "", None], C.infer_pet) == [False, True, True, False, None, None]
    assert run(spark, ["sem fiador, com caução de 3 meses", "fiador ou seguro fiança", None], C.infer_guarantees) == [["Sem fiador", "Caução"], ["Fiador", "Seguro-fiança"], []]


def test_text(spark):
    assert run(spark, ["<p>Linha 1<br>Linha&nbsp;2</p><ul><li>item</li></ul>", "", None, "<script>x</script>"], T.html_to_text) == ["Linha 1\nLinha 2\n- item", None, None, None]
    assert run(spark, ["&amp;lt; &#65;&#x42;&bogus;&#0;", None], T.decode_entities) == ["&lt; AB&bogus;", None]
    assert run(spark, ["  a  b\n", " ", None], T.inline) == ["a b", None, None]
    assert run(spark, ["São Manuel", "--A  b--", None], T.slugify) == ["sao-manuel", "a-b", None]
    assert run(spark, ["VILA NOVA DE BOTUCATU", "Vila", "AB", None], T.fix_upper_case) == ["Vila Nova de Botucatu", "Vila", "AB", None]
    assert run(spark, ["Jd. Paraíso", "Jardim Paraiso", "Vl Maria (centro)", None], T.normalize_bairro) == ["jardim paraiso", "jardim paraiso", "vila maria centro", ""]
    assert run(spark, ["Dupla Negócios Imobiliários", None], T.normalize_name) == ["dupla", ""]
    assert run(spark, ["Vila Maria", "Jardim X"], T.preposition) == ["na", "no"]
    assert run(spark, ["são manuel"], T.title_slug) == ["Sao-Manuel"]
    assert run(spark, ["ap-12/b"], T.norm_ref) == ["AP12B"]
    assert run(spark, [1234.5, 10.0, None], T.brl, "double") == ["R$ 1.234,5", "R$ 10", "—"]
    assert run(spark, ["a b/ç"], T.link_text) == ["a%20b%2F%C3%A7"]
    assert run(spark, [[" a", "b", "a ", "", None], None], T.uniq, "array<string>") == [["a", "b"], []]
