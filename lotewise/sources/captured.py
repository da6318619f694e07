"""Captured answers as a Spark data source: what a search asks of its sources, and the answers that were captured to it.

``spark.read.format("lotewise_pages")`` gives one row for each page asked for and captured. A partition is one
page of one source, so a page is read where its task runs and no other page with it. Filters on ``cidade``,
``aluguel_max`` and ``tipo`` are pushed: they are what the platforms are asked (an address, or the body of an API
request), and decide which paths of the aggregator are read at all. Captures lie in a folder partitioned by
``fonte`` and ``page`` with the columns caminho, url, corpo, status, html; the request is the key.

Options: ``path``, ``fontes`` (JSON list of sources: id, plataforma, url; for msys also ``cidades``, ids by slug, and
``opcoes``), ``uf``, and, where no filter says it, ``cidade``; ``max_paginas``, ``limite`` (rows a source: pages that
cannot be needed for it are not read) and ``ordem`` (the order that a source that sorts is asked for).
"""

from __future__ import annotations

import json
import math
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlencode

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

NAME = "lotewise_pages"
SCHEMA = "fonte string, plataforma string, fonte_nome string, base string, caminho string, page int, cidade string, aluguel_max double, tipo string, url string, corpo string, status int, html string"
#: Entries of a platform's page, the most pages of a search, and of a path of the aggregator (fixed values).
PAGE_SIZES = {"msys": 50, "kenlo": 12, "chavesnamao": 15}
MOST, MOST_OF_PATH = 20, 5
#: Result paths of the aggregator and the types of listing that each holds, in the order they are read (fixed values).
PATHS = (
    ("apartamentos-para-alugar", ("apartamento", "flat")),
    ("kitnet-para-alugar", ("kitnet", "studio")),
    ("casas-para-alugar", ("casa", "sobrado")),
    ("casas-em-condominio-para-alugar", ("casa_condominio",)),
    ("coberturas-para-alugar", ("cobertura",)),
)
#: The order that msys is asked for, and the fields of its answers (fixed values).
ORDER = "dtaUpdate desc"
FIELDS = (
    "idtProperty", "jsonPhotos", "namStreet", "namDistrict", "namCity", "namState", "namCategory", "namSubCategory", "namCondominium", "valLocation",
    "valMonthIptu", "valIptuCalculated", "valCondominium", "valCondominiumCalculated", "latitude", "longitude", "flgShowMapSite", "totalRooms",
    "totalGarages", "idtsCharacteristics", "idtsCondominiumCharacteristics", "indType", "desTitleSite", "desInformationSite", "dtaUpdate", "dtaInsert",
    "flgPendingLocation", "flgReservedLocation", "flgHideValLocationSite", "flgRentByPeriod",
)
#: Characteristics that msys answers hold as columns of their own (fixed values).
FIELD_CHARACTERISTICS = (1, 2, 5, 6, 7, 12, 27, 95, 176, 194, 467, 621)


def paths_for(types: list[str] | None) -> list[str]:
    """The aggregator's paths that can hold a wanted type; all where none is named."""
    return [p for p, kinds in PATHS if not types or set(kinds) & set(types)]


@dataclass(frozen=True)
class Ask:
    """What a search wants of every source."""

    cidade: str
    uf: str = ""
    aluguel_max: float | None = None
    tipos: tuple[str, ...] = ()
    max_paginas: int = MOST
    limite: int | None = None
    ordem: str = ORDER


@dataclass
class Request(InputPartition):
    """One page of a source's results: its address, and the body that is posted to it."""

    fonte: str
    plataforma: str
    fonte_nome: str
    base: str
    caminho: str | None
    page: int
    tipo: str | None
    url: str
    corpo: str | None = None


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def _words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in _plain(text)).split()


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def _with(address: str, asked: dict[str, str], safe: str = "") -> str:
    return f"{address}?{urlencode(asked, quote_via=quote, safe=safe)}" if asked else address


def requests(source: dict, ask: Ask) -> list[Request]:
    """The pages of a source that a search may read, in their order; none where the source does not have the city."""
    kind, base = source["plataforma"], source["url"].rstrip("/")
    slug = "-".join(_words(ask.cidade)).lower()
    size = PAGE_SIZES.get(kind)
    last = min(ask.max_paginas, math.ceil(ask.limite / size) if ask.limite and size else ask.max_paginas)
    wanted = lambda kinds: next((t for t in ask.tipos if t in kinds), None)
    row = lambda page, url, corpo=None, caminho=None, tipo=None: Request(source["id"], kind, source.get("nome") or source["id"], base, caminho, page, tipo or (ask.tipos[0] if ask.tipos else None), url, corpo)
    if kind == "chavesnamao":
        kinds = dict(PATHS)
        city = f"{ask.uf.lower()}-{slug}"
        return [row(n, _with(f"{base}/{p}/{city}/", {"pg": str(n)} if n > 1 else {}), None, p, wanted(kinds[p])) for p in paths_for(list(ask.tipos)) for n in range(1, min(last, MOST_OF_PATH) + 1)]
    if kind == "msys":
        place = source.get("cidades", {}).get(slug)
        options = source.get("opcoes", {})
        if place is None:
            return []
        fixed = {"fieldList": [*FIELDS, *[f"prop_char_{n}" for n in FIELD_CHARACTERISTICS]], "jsonPhotosNum": 40, **{k: bool(options.get(k)) for k in ("hidePendingLocation", "hidePrevisionOutput")}}
        body = lambda n: {"type": "L", "idtCityList": [place], "toPrice": ask.aluguel_max, "start": (n - 1) * size, "numRows": size, "getAccess": True, "post": True, "sortList": [ask.ordem], **fixed}
        return [row(n, f"{base}/api/service/consult", json.dumps(body(n), separators=(",", ":"))) for n in range(1, last + 1)]
    if kind == "ksi":
        at, price, page = f"{base}/alugar/{'-'.join(w.capitalize() for w in _words(ask.cidade))}", ("vma", "{}"), "pag"
    elif kind == "kenlo":
        at, price, page = f"{base}/imoveis/para-alugar/{slug}", ("preco-de-locacao", "0~{}"), "pagina"
    else:
        raise ValueError(f"unknown platform {kind!r}")
    first = {price[0]: price[1].format(_number(ask.aluguel_max))} if ask.aluguel_max else {}
    return [row(n, _with(at, first | ({page: str(n)} if n > 1 else {}), safe="~")) for n in range(1, last + 1)]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.sources = json.loads(options["fontes"])
        number = lambda k: int(options[k]) if options.get(k) else None
        self.ask = {"cidade": options.get("cidade"), "uf": options.get("uf", ""), "max_paginas": number("max_paginas") or MOST, "limite": number("limite"), "ordem": options.get("ordem") or ORDER}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality on city and ceiling, and types, are what is asked; the rest is left to Spark."""
        pushed, left = set(), []
        for f in filters:
            name = ".".join(f.attribute) if isinstance(f, EqualTo | In | IsNotNull) else None
            if isinstance(f, EqualTo) and name in ("cidade", "aluguel_max") and self.ask.get(name) in (None, f.value):
                self.ask[name] = f.value
                pushed.add(name)
            elif isinstance(f, EqualTo | In) and name == "tipo" and "tipos" not in self.ask:
                self.ask["tipos"] = tuple(f.value) if isinstance(f, In) else (f.value,)
                pushed.add(name)
            else:
                left.append((name, f))
        yield from (f for name, f in left if not (isinstance(f, IsNotNull) and name in pushed))

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Request]:
        """The pages that a search may ask for and that have captures: at most ``max_paginas`` for each source and path."""
        from pyarrow import fs

        if not self.ask["cidade"]:
            raise ValueError("a search needs a city: filter on cidade, or set the option")
        store, root = self._folder()
        out = []
        for source in self.sources:
            there = {f.base_name for f in store.get_file_info(fs.FileSelector(f"{root}/fonte={source['id']}", allow_not_found=True))}
            out += [r for r in requests(source, Ask(**self.ask)) if f"page={r.page}" in there]
        return out

    def read(self, request: Request) -> Iterator:
        """The answers as Arrow batches: a page may be as long as a source is large, and is handed on without a copy of its text."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = self._folder()
        told = (request.fonte, request.plataforma, request.fonte_nome, request.base, request.caminho, request.page, self.ask["cidade"], self.ask.get("aluguel_max"), request.tipo, request.url, request.corpo)
        text, whole, real = pa.string(), pa.int32(), pa.float64()
        kinds = (text, text, text, text, text, whole, text, real, text, text, text)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for info in store.get_file_info(fs.FileSelector(f"{root}/fonte={request.fonte}/page={request.page}", recursive=True)):
            if info.type != fs.FileType.File or not info.size or info.base_name.startswith(("_", ".")):
                continue
            with store.open_input_file(info.path) as source:
                file = pq.ParquetFile(source, pre_buffer=False)
                for group in range(file.num_row_groups):
                    keys = file.read_row_group(group, columns=["url", "corpo", "status"], use_threads=False)
                    body = keys["corpo"]
                    same = pc.and_kleene(pc.equal(keys["url"], request.url), pc.is_null(body) if request.corpo is None else pc.equal(body, request.corpo))
                    wanted = [i for i, x in enumerate(same.to_pylist()) if x]
                    at = 0
                    # answers are long: only a group that has a wanted one is read, a row at a time
                    for page in file.iter_batches(batch_size=1, row_groups=[group], columns=["html"], use_threads=False) if wanted else ():
                        if at in wanted:
                            status = pa.array([keys["status"][at].as_py()], whole)
                            yield pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(told, kinds, strict=True)), status, page.column(0).cast(text)], names=names)
                        at += 1
        pa.default_memory_pool().release_unused()  # a worker goes on to other pages


class CapturedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CapturedPages)


def write_captures(captures: DataFrame, path: str) -> None:
    """Captures (fonte, page, caminho, url, corpo, status, html) as the source reads them."""
    captures.select("fonte", "page", "caminho", "url", "corpo", "status", "html").write.partitionBy("fonte", "page").parquet(path)


def search(spark: SparkSession, path: str, fontes: list[dict], cidade: str, *, aluguel_max: float | None = None, tipos: list[str] | None = None, **options) -> DataFrame:
    """The captured pages of a search, its wishes as filters; options as the source takes them."""
    register(spark)
    told = {k: str(v) for k, v in options.items() if v is not None}
    pages = spark.read.format(NAME).options(path=path, fontes=json.dumps(fontes), **told).load().where(F.col("cidade") == cidade)
    if aluguel_max is not None:
        pages = pages.where(F.col("aluguel_max") == float(aluguel_max))
    return pages.where(F.col("tipo").isin(*tipos)) if tipos else pages
