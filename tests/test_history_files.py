"""Documents read in pieces: the rows and problems of the reader that takes a document whole."""

import json
import os
import tempfile

import pytest

from callweave.sources import history_files as HF
from callweave.sources import sinks as SK

ODD = ['plain', 'a } in { text [ ]', 'quote " and \\ and \\" }', '\\', '\n\t}', '', '😀 }{', '{"#": 1}', '"analyses": [{', None]


def analysis(i):
    return {"id": i, "timestamp": "2024-01-02T03:04:05", "query": ODD[i % len(ODD)], "enhanced_query": None, "analysis_result": "x}" * (i % 40),
            "confidence_score": i / 100, "functions_analyzed": i, "services_used": {"embedding": "e", "llm": None if i % 3 else "m}"},
            "context": {"repo_name": "r", "priority": "p", "tech_stack": ["a", "}", "]"]}, "unknown": [{"deep": [{"er": "}"}]}, []]}


def doc(n, **more):
    return {"created_at": "2024", "note": {"a": {"b": [{}]}, "c": {}}, "analyses": [analysis(i) for i in range(n)], "version": "1.0}", "other": [{"id": 5}, {"id": 6}], **more}


def folder(files):
    root = tempfile.mkdtemp(prefix="history-", dir="/tmp")
    for name, text in files.items():
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            f.write(text)
    return root


FILES = {
    "indented.json": json.dumps(doc(60), indent=2, ensure_ascii=False),
    "line.json": json.dumps(doc(45)) + "\n",
    "tight.json": json.dumps(doc(7), separators=(",", ":")),
    "lists.json": '{"a": {"of": [{"id": 1}, [{"id": 2}]], "b": [[], {}], "c": {"d": [{}]}}, "analyses": [{"id": 800, "x": [{}, [{}], {"y": [[{}]]}]}, {"id": 801}], "z": {"of": [{"id": 1}]} }',
    "none.json": json.dumps(doc(0)),
    "nulls.json": '{"analyses": [null, {"id": 900}, null, {"id": 901}, {"id": 902}], "x": 1}',
    "no_key.json": json.dumps({"entries": [analysis(1), analysis(2)], "version": "1"}),
    "cut.json": json.dumps(doc(20), indent=2)[:-400],
    "cut_in_a_list.json": '{"analyses": [{"id": 1}, {"id": 2}',
    "no_comma.json": '{"analyses": [{"id": 1} {"id": 2}]}',
    "last_comma.json": '{"analyses": [{"id": 1}, {"id": 2}, ]}',
    "bad_record.json": '{"analyses": [{"id": 1}, {"id": }, {"id": 3}]}',
    "text.json": "no document at all",
    "empty.json": "",
}


def both(reader, spark, root):
    rows, problems = reader(spark, root)
    return sorted(map(str, rows.collect())), sorted((os.path.basename(p[0]), p[1]) for p in problems.collect())


@pytest.mark.parametrize("split", [128 << 20, 700])
def test_equal_to_the_whole_reader(spark, split):
    root = folder(FILES)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = both(SK.read_history_files, spark, root)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = both(HF.read_history_split, spark, root)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got[1] == want[1]
    assert got[0] == want[0] and len(got[0]) == 60 + 45 + 7 + 2 + 5


def test_a_document_is_read_by_several_tasks(spark):
    root = folder({"one.json": json.dumps(doc(300))})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        assert HF._pieces(spark, root).select("block").distinct().count() > 5
        rows, problems = HF.read_history_split(spark, root)
        assert sorted(r.id for r in rows.collect()) == list(range(300)) and problems.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("split", [128 << 20, 700])
def test_several_documents_a_file(spark, split):
    """The rows and problems of the same documents with a file each."""
    want = both(SK.read_history_files, spark, folder(FILES))
    texts = list(FILES.values())
    root = folder({"a.json": "".join(HF.MARK + t + "\n" for t in texts[:8]), "b.json": HF.MARK + HF.MARK.join(texts[8:]) + HF.MARK, "c.json": texts[0]})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows, problems = both(lambda s, path: HF.read_history_split(s, path, HF.MARK), spark, root)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    more = both(SK.read_history_files, spark, folder({"c.json": texts[0]}))[0]
    assert rows == sorted(want[0] + more)
    assert sorted(p for _, p in problems) == sorted(p for _, p in want[1])


def test_documents_of_users_share_files(spark):
    """No file or folder a user: their number does not grow with the documents."""
    from callweave.plans import sink_queries as Q
    from tests.conftest import SF001
    path = Q.history_documents(spark, SF001)
    found = [x for _, _, names in os.walk(path.removeprefix("file:")) for x in names if x.endswith(".txt")]
    users = spark.read.parquet(f"{SF001}/events.parquet").select("user_id").distinct().count()
    text = spark.read.option("wholetext", True).text(path)
    assert sum(r.value.count(HF.MARK) for r in text.collect()) == users > 2 * len(found)
