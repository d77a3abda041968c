"""Layout, images, judges, snapshots and workbooks as sources and sinks."""

import base64
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import prompts
from corpusmill.operators import judging, layout
from corpusmill.sources import files, images, models, workbook
from corpusmill.sources import layout as paged


#: A format of its own: a JSON document of pages. A lambda, since executors don't have this module.
reader = lambda: lambda content: json.loads(content)["pages"]


@pytest.fixture(scope="module")
def documents(tmp_path_factory):
    root = tmp_path_factory.mktemp("paged")
    line = lambda y, text, size=10.0, font="Regular", x=60.0: {"x0": x, "top": y, "x1": x + 9, "text": text, "size": size, "font": font}
    one = {
        "lines": [line(20.0, "Header"), line(100.0, "Clinical question: what", 12.0, "Sans-Bold"), line(120.2, "is known"), line(120.4, "is known")],
        "tables": [{"top": 90.0, "rows": [["Symptom", "Cancer", "Action"], ["Cough", "Lung", None]]}], "contents": [[1, "Guide", 1], [2, "Lung", 2]],
    }
    (root / "a.bin").write_text(json.dumps({"pages": [one, {"lines": [line(100.0, "Table 1: x"), line(130.0, "row")], "tables": []}]}))
    (root / "b.bin").write_text(json.dumps({"pages": []}))
    return str(root)


def test_layout_is_read_and_cut_to_records(spark, documents):
    lines = paged.read_lines(spark, documents, reader)
    rows = lines.orderBy("page", "ord").collect()
    assert [(r.page, r.ord, r.text, r.font) for r in rows][1] == (1, 2, "Clinical question: what", "Sans-Bold") and len(rows) == 6
    own = lines.withColumns({"section": F.lit("s"), "fonts": F.array("font"), "ord": F.col("page") * 100 + F.col("ord"), "height": F.lit(800.0)})
    kept = layout.distinct_lines(own).where(~layout.furniture("y", "x", "height"))
    modes = {(r.record, r.mode): r.n for r in layout.modes(kept).groupBy("record", "mode").agg(F.count("*").alias("n")).collect()}
    assert modes == {(1, "clinical_question"): 2, (2, "evidence_table"): 2}


def test_tables_and_contents(spark, documents):
    rows = paged.read_tables(spark, documents, reader).orderBy("row").collect()
    assert [(r.page, r.table, r.row, r.cells) for r in rows] == [(1, 0, 0, ["Symptom", "Cancer", "Action"]), (1, 0, 1, ["Cough", "Lung", None])]
    toc = paged.read_contents(spark, documents, reader).orderBy("ord").collect()
    assert [(r.level, r.title, r.page) for r in toc] == [(1, "Guide", 1), (2, "Lung", 2)]


def test_inspection(spark, documents):
    row = paged.inspection(paged.read_lines(spark, documents, reader), paged.read_contents(spark, documents, reader)).collect()
    assert len(row) == 1 and (row[0].pages_with_text, row[0].bookmarks, row[0].sections_follow, row[0].most) == (2, 2, True, 45)


PNG = b"\x89PNG\r\n\x1a\n"


def test_images_are_checked_and_described(spark):
    b64 = lambda b: base64.b64encode(b).decode()
    rows = [
        ("png", "image/png", b64(PNG + b"x"), None), ("jpg", "IMAGE/JPEG", b64(b"\xff\xd8\xff\xe0"), None), ("webp", "image/webp", b64(b"RIFF1234WEBPVP8"), None),
        ("gif", "image/gif", b64(b"GIF89a"), "unsupported_type"), ("text", "image/png", "not base64!", "invalid_base64"), ("none", "image/png", None, "empty"),
        ("large", "image/png", b64(PNG + b"x" * 99), "too_large"), ("other", "image/webp", b64(b"RIFF1234WAVEfmt"), "wrong_content"), ("null", None, b64(PNG), "unsupported_type"),
    ]
    frame = spark.createDataFrame(rows, "id string, media_type string, data string, want string").withColumn("question", F.lit("what?"))
    assert all(r.got == r.want for r in frame.select("want", images.problem("media_type", "data", 64).alias("got")).collect())
    found = images.describe(frame, lambda: lambda kind, data, asked: json.dumps({"kind": kind, "n": len(data)}))
    got = {r.id: r.found for r in found.collect()}
    assert json.loads(got["png"]) == {"kind": "image/png", "n": 9} and got["gif"] is None and got["none"] is None


def judges():
    """A judge that takes the first label, and breaks off at a bad prompt."""

    def judge():
        def run(pairs):
            out = []
            for prompt, schema in pairs:
                labels = json.loads(schema)["properties"]["label"]["enum"]
                out.append("broken" if "bad" in prompt else f'```json\n{{"label": "{labels[0]}", "reason": "r", "claim_ids": ["C1"]}}\n```')
            return out

        return run

    return judge


def test_judges_answer_prompts(spark):
    e = spark.createDataFrame([("t1", "good question"), ("t2", "bad question")], "task_id string, question string")
    e = e.withColumns({"claim": F.lit("C1: it is"), "evidence": F.array(F.struct(F.lit("[E1]").alias("label"), F.lit("Page 1").alias("citation"), F.lit("It is.").alias("text")))})
    tasks = e.withColumn("prompt", prompts.claim_support()).withColumn("schema", F.lit(prompts.schema("claim_support"))).withColumn("criterion", F.lit("claim_support"))
    text = tasks.where("task_id = 't1'").first().prompt
    assert "Question:\ngood question" in text and "[E1] | Page 1\nIt is." in text and text.startswith(prompts.RULES)
    out = models.judge(tasks, judges())
    assert {r.task_id: (r.label, r.reason, r.claim_ids) for r in out.collect()} == {"t1": ("SUPPORTED", "r", ["C1"]), "t2": (None, None, None)}
    assert [r.task_id for r in judging.valid(out).collect()] == ["t1"]
    assert json.loads(prompts.schema("overreach"))["required"] == ["label", "reason", "claim_ids"]


def test_every_prompt_names_its_criterion(spark):
    row = spark.range(1).select(*[F.lit("x").alias(c) for c in ("question", "claim", "answer", "expected")])
    none = F.array().cast("array<struct<label:string,citation:string,text:string>>")
    row = row.withColumns({"evidence": none, "cited": none, "claims": F.array().cast("array<struct<claim_id:string,claim:string>>")})
    for name, rule in prompts.CRITERIA.items():
        text = row.select(getattr(prompts, name)()).first()[0]
        assert f"Criterion {name}: {rule}" in text
        assert ("No passage was cited." in text) == (name != "refusal_quality")


def test_models_are_probed(spark):
    def failing():
        raise RuntimeError("down")

    assert models.healthy(spark, lambda: lambda texts: texts) and not models.healthy(spark, failing)


def test_snapshots_copies_and_reports(spark, tmp_path):
    path = str(tmp_path / "run")
    assert files.read_snapshot(spark, path, "id long").count() == 0
    files.write_snapshot(spark.range(2), path, 1)
    files.write_snapshot(spark.range(5), path, 2)
    assert files.read_snapshot(spark, path, "id long").count() == 5
    files.drop_snapshots(spark, path)
    assert files.read_snapshot(spark, path, "id long").count() == 0
    (tmp_path / "a.json").write_text('{"rows": 3}')
    assert files.copy_file(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")) and (tmp_path / "b.json").read_text() == '{"rows": 3}'
    assert not files.copy_file(spark, str(tmp_path / "a.json"), str(tmp_path / "a.json"))
    row = files.read_reports(spark, str(tmp_path / "a.json"), {"index": str(tmp_path / "b.json"), "run": str(tmp_path / "none.json")}).first()
    assert row.report.rows == 3 and row["index"].rows == 3 and row.run is None
    with pytest.raises(Exception):  # noqa: B017
        files.read_reports(spark, str(tmp_path / "none.json"), {}).first()


def test_chained_digest_follows_the_list(spark):
    rows = [(2, "b", "y"), (1, "a", "x"), (3, "c", "z")]
    got = files.chained_digest(spark.createDataFrame(rows, "ord int, path string, digest string")).first().digest
    assert got == hashlib.sha256(b"axbycz").hexdigest()


def test_workbook(spark, monkeypatch):
    rows = spark.createDataFrame([("q1", True, 0.5, "=1+1"), ("q2", None, None, "a<b")], "id string, ok boolean, share double, note string")
    data = workbook.workbook({"Review": rows, "Totals": [["rate", workbook.share_formula("Review", "B", "TRUE")]]})
    z = zipfile.ZipFile(io.BytesIO(data))
    first, second = (z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2))
    assert 't="b"><v>1</v>' in first and "<v>0.5</v>" in first and "'=1+1" in first and "<f>" not in first and "a&lt;b" in first
    assert "COUNTIF('Review'!B2:B50001,\"TRUE\")" in second and "<f>" in second and z.testzip() is None
    monkeypatch.setattr(workbook, "MOST", 1)
    with pytest.raises(ValueError, match="more than 1 rows"):
        workbook.workbook({"Review": rows})


def test_vectors_of_numpy_files(spark, tmp_path):
    import numpy as np

    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "a.npy", x)
    got = files.read_npy(spark, str(tmp_path / "a.npy"), rows=3).orderBy("row").collect()
    assert [(r.row, r.embedding) for r in got] == [(i, v.tolist()) for i, v in enumerate(x)]
    np.save(tmp_path / "b.npy", np.arange(3))
    with pytest.raises(Exception, match="no rows of vectors"):
        files.read_npy(spark, str(tmp_path / "b.npy")).collect()
