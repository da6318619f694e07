"""Schemas of listings, state rows and runs, and the fixed sets of values in them."""

CONTACT = "struct<nome:string,papel:string,telefone:string,whatsapp:string,email:string,creci:string>"
LISTING = (
    "id string, fonte string, plataforma string, anunciante string, url string, titulo string, tipo string, subtipo string, "
    "aluguel double, condominio double, iptu double, total double, quartos int, suites int, banheiros int, vagas int, area double, "
    "bairro string, endereco string, cidade string, uf string, lat double, lng double, coord_aprox boolean, fotos array<string>, "
    "descricao string, caracteristicas array<string>, mobiliado boolean, aceita_pet boolean, garantias array<string>, "
    f"contatos array<{CONTACT}>, referencia string, publicado_em string, atualizado_em string, detalhado boolean"
)
LIFECYCLE = (
    "chave string, primeira_vez string, ultima_vez string, ativo boolean, inativo_desde string, "
    "historico_precos array<struct<data:string,aluguel:double,total:double>>, grupo string, status string, status_em string, notas string, "
    "ia struct<nota:int,resumo:string,alertas:array<string>,data:string>, ord bigint"
)
STATE = f"{LISTING}, {LIFECYCLE}"
RUN = "id string, inicio string, fim string, fontes map<string,struct<ok:boolean,encontrados:int,novos:int,atualizados:int,removidos:int,detalhados:int,erro:string,avisos:array<string>,ms:bigint>>, novos bigint"
#: The keys that a run found first, in stored order: a row each, as a run may find any number.
NEWS = "inicio string, pos bigint, chave string"

#: Fixed values.
RESIDENTIAL = ("apartamento", "kitnet", "studio", "cobertura", "flat", "casa", "sobrado", "casa_condominio")
NON_RESIDENTIAL = ("comercial", "terreno", "rural")
STATUSES = ("novo", "interesse", "contatado", "visita", "proposta", "descartado")
AGGREGATORS = ("chavesnamao",)
#: Fields that an empty incoming value never erases.
DETAIL_FIELDS = ("descricao", "condominio", "iptu", "suites", "vagas", "area", "referencia", "publicado_em", "garantias", "mobiliado", "aceita_pet", "anunciante", "endereco", "caracteristicas", "contatos", "fotos")


def columns(schema: str) -> list[tuple[str, str]]:
    """(name, type) of a schema string's fields."""
    out, depth, part = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append((name, kind))
            part = ""
        else:
            part += c
    return out
