"""The reader of captured pages hands answers on as Arrow batches of one page."""

import json

import pyarrow as pa
import pyarrow.parquet as pq

from lotewise.sources import captured


def test_one_page_a_batch(tmp_path):
    site = {"id": "f0", "nome": "F0", "plataforma": "msys", "url": "https://f0.example", "cidades": {"botucatu": 7}}
    r = captured.Reader({"path": str(tmp_path), "fontes": json.dumps([site]), "cidade": "Botucatu"})
    asked = captured.requests(site, captured.Ask("Botucatu"))[0]
    at = tmp_path / "fonte=f0" / "page=1"
    at.mkdir(parents=True)
    bodies = [asked.corpo, "{}", None, asked.corpo]
    pages = pa.table({"caminho": pa.nulls(4, pa.string()), "url": [asked.url] * 4, "corpo": bodies, "status": pa.array([200, 200, 200, 500], pa.int32()), "html": ["á", "other", "none", None]})
    pq.write_table(pages, at / "a.parquet", row_group_size=3)
    (request,) = r.partitions()
    got = list(r.read(request))
    assert all(isinstance(b, pa.RecordBatch) and b.num_rows == 1 for b in got)
    assert [(b["fonte"][0].as_py(), b["page"][0].as_py(), b["status"][0].as_py(), b["html"][0].as_py()) for b in got] == [("f0", 1, 200, "á"), ("f0", 1, 500, None)]
