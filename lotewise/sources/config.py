"""Search configuration: JSON over defaults, validated."""

from __future__ import annotations

import json
import re
from urllib.parse import urlsplit
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SOURCES = "pos int, id string, nome string, plataforma string, url string, ativo boolean, apelidos array<string>, aviso string"


@dataclass
class Config:
    cidade: str
    uf: str
    fontes: list[dict] = field(default_factory=list)
    ddd: str = ""
    aluguel_max: float = 2000
    tipos: list[str] = field(default_factory=lambda: ["apartamento", "kitnet", "studio", "cobertura", "flat", "casa", "sobrado", "casa_condominio"])
    quartos_min: int = 0
    buscar_detalhes: bool = True
    max_paginas: int = 20
    concorrencia: int = 4
    mensagem: str = ""
    links_manuais: list[dict] = field(default_factory=list)


def load(text: str) -> Config:
    """Parse and check a configuration."""
    raw = json.loads(text)
    if not raw.get("cidade") or not raw.get("uf"):
        raise ValueError("cidade and uf are required")
    if not isinstance(raw.get("fontes"), list):
        raise ValueError("fontes must be a list")
    c = Config(**{k: v for k, v in raw.items() if k in Config.__dataclass_fields__})
    seen: set[str] = set()
    for f in c.fontes:
        if not re.fullmatch(r"[a-z0-9_-]+", f.get("id") or ""):
            raise ValueError(f"bad source id {f.get('id')!r}")
        if f["id"] in seen:
            raise ValueError(f"source {f['id']} is given twice")
        seen.add(f["id"])
        f.setdefault("nome", f["id"])
        f["ativo"] = f.get("ativo", True)
    c.uf = c.uf.upper()
    c.aluguel_max = c.aluguel_max or 2000
    c.concorrencia = min(8, max(1, int(c.concorrencia or 1)))
    return c


def sources(spark: SparkSession, c: Config, only: list[str] | None = None) -> DataFrame:
    """The source catalogue in order; explicit ids ignore ``ativo`` and must exist."""
    unknown = set(only or []) - {f["id"] for f in c.fontes}
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(sorted(unknown))}")
    rows = [(i, f["id"], f["nome"], f.get("plataforma"), f.get("url"), bool(f["ativo"]), f.get("apelidos") or [], f.get("aviso")) for i, f in enumerate(c.fontes)]
    df = spark.createDataFrame(rows, SOURCES)
    return df.where(df.id.isin(*only)) if only else df.where("ativo")


def ad_hoc(platform: str, site: str, name: str | None = None) -> dict:
    """A source that no configuration names, from its platform and site."""
    url = site.rstrip("/")
    host = urlsplit(url).hostname or ""
    if not host:
        raise ValueError(f"{site!r} is no address")
    return {"id": re.sub("[^a-z0-9]", "", host.removeprefix("www.").split(".")[0]), "nome": name or host, "plataforma": platform, "url": url, "ativo": True}


def from_environment(env: dict[str, str]) -> dict[str, str]:
    """Where the configuration and the state are, unless the environment says otherwise."""
    return {"config": env.get("LOTEWISE_CONFIG", "config/sources.json"), "data": env.get("LOTEWISE_DATA", "data")}
