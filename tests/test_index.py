import json
from hashlib import sha256

import pandas as pd
import pytest

from critiq.operators.documents import build_documents
from critiq.operators.identity import assign_source_ids
from critiq.operators.mapping import ColumnMapping, ReviewDataError
from critiq.operators.normalize import normalize_reviews
from critiq.operators.reconcile import reconcile_index
from critiq.plans.tables import letter_counts
from critiq.sources.index import commits, index_count, read_index
from critiq.sources.registry import dataset_digest, file_digests, register_dataset
from critiq.streaming.jobs import CopyCounter, add_reviews, stream_index, stream_search


def _docs(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "Review string")
    return build_documents(assign_source_ids(normalize_reviews(df)))


def _texts(spark, path):
    return sorted(r.content[8:] for r in read_index(spark, path).collect())


def test_reconcile_adds_changes_deletes_and_rests(spark, tmp_path):
    path = str(tmp_path / "index")
    assert index_count(spark, path) == 0 and read_index(spark, path) is None
    assert reconcile_index(spark, path, _docs(spark, ["a", "b", "b"]), letter_counts) == (3, 0)
    assert index_count(spark, path) == 3
    assert reconcile_index(spark, path, _docs(spark, ["a", "b", "b"]), letter_counts) == (0, 0)
    assert len(commits(spark, path)) == 1
    # one of two copies goes, one record changes
    assert reconcile_index(spark, path, _docs(spark, ["a!", "b"]), letter_counts, 2) == (1, 2)
    assert _texts(spark, path) == ["a!", "b"]
    # a record that was dropped comes back
    assert reconcile_index(spark, path, _docs(spark, ["a", "a!", "b"]), letter_counts) == (1, 0)
    assert _texts(spark, path) == ["a", "a!", "b"]
    assert read_index(spark, path).columns == _docs(spark, ["a"]).columns + ["embedding"]


def test_failed_run_leaves_the_snapshot_and_is_made_up_for(spark, tmp_path):
    path = str(tmp_path / "index")
    reconcile_index(spark, path, _docs(spark, ["a"]), letter_counts)

    def broken(texts):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        reconcile_index(spark, path, _docs(spark, ["a", "b"]), broken)
    assert _texts(spark, path) == ["a"]
    assert reconcile_index(spark, path, _docs(spark, ["a", "b"]), letter_counts) == (1, 0)
    assert _texts(spark, path) == ["a", "b"]


def test_registry(spark, tmp_path):
    content = b"First,Second\nhello,world\n"
    path = tmp_path / "up.csv"
    path.write_bytes(content)
    root = str(tmp_path / "store")
    one = register_dataset(spark, str(path), root, ColumnMapping(review="First"))
    again = register_dataset(spark, str(path), root, ColumnMapping(review="First"))
    other = register_dataset(spark, str(path), root, ColumnMapping(review="Second"))
    roles = {r: None for r in ("title", "date", "rating", "sentiment", "restaurant", "country")}
    body = json.dumps({**roles, "review": "First"}, sort_keys=True, separators=(",", ":"))
    assert one.digest == sha256(content + b"\0" + body.encode()).hexdigest()
    assert one == again and one.digest != other.digest
    assert one.collection == f"reviews_{one.digest[:12]}" and one.review_count == 1
    assert spark.read.parquet(other.data_path).head().Review == "world"
    bad = tmp_path / "bad.csv"
    bad.write_text("Review,Rating\nx,9\n")
    with pytest.raises(ReviewDataError, match="Rating"):
        register_dataset(spark, str(bad), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    (tmp_path / "many").mkdir()
    for name in ("1", "2"):
        (tmp_path / "many" / f"{name}.csv").write_text(f"Review\n{name}\n")
    assert len(dataset_digest(spark, str(tmp_path / "many"))) == 64


@pytest.mark.parametrize("content", [
    b"\n", b"a", b"a\n", b"a\n\n", b"\r\n\xff\x00b\rc", b"\xef\xbb\xbfmark\nx",
    b"line\n" * 3000,
])
def test_streamed_digest_is_that_of_the_bytes(spark, tmp_path, content):
    (tmp_path / "f.csv").write_bytes(content)
    for suffix in (b"", b"\0x"):
        want = sha256(content + suffix).hexdigest()
        for above in (-1, 1 << 20):
            found = file_digests(spark, str(tmp_path / "f.csv"), suffix, whole_bytes=above)
            assert [(r.length, r.digest) for r in found.collect()] == [(len(content), want)]


def test_digest_of_a_dataset_is_one_rule(spark, tmp_path):
    sums = 0
    for name in ("1", "2", "3"):
        (tmp_path / f"{name}.csv").write_text(f"Review\n{name}\n")
        sums += int(sha256(f"Review\n{name}\n".encode()).hexdigest(), 16)
    assert dataset_digest(spark, str(tmp_path)) == f"{sums % 2**256:064x}"
    one = sha256(b"Review\n1\n").hexdigest()
    assert dataset_digest(spark, str(tmp_path / "1.csv")) == one


def test_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    batch = normalize_reviews(spark.createDataFrame([("a",), ("a",)], "Review string"))
    add_reviews(spark, path, batch, letter_counts, "s:0")
    add_reviews(spark, path, batch, letter_counts, "s:0")
    assert index_count(spark, path) == 2
    add_reviews(spark, path, batch, letter_counts, "s:1")
    ids = sorted(r.source_id.partition("_")[2][32:] for r in read_index(spark, path).collect())
    assert ids == ["", "_2", "_3", "_4"]


def test_streams(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()

    def run():
        stream_index(
            spark, str(folder), ["Comment", "Stars"], ColumnMapping(review="Comment", rating="Stars"),
            path, letter_counts, str(tmp_path / "cp"),
        ).awaitTermination()

    (folder / "1.csv").write_text('Comment,Stars\n"aaa\nline",5\nbbb,NA\n')
    run()
    (folder / "2.csv").write_text("Comment,Stars\nbbb,\nccc,1\n")
    run()
    run()
    rows = read_index(spark, path).collect()
    assert sorted(r.content for r in rows) == [
        "Review: aaa\nline", "Review: bbb", "Review: bbb", "Review: ccc"
    ]
    asks = tmp_path / "asks"
    asks.mkdir()
    (asks / "1.json").write_text('{"query_id": 7, "question": "Review: ccc"}\n')
    questions = spark.readStream.schema("query_id int, question string").json(str(asks))
    for _ in range(2):
        stream_search(
            questions, path, letter_counts, str(tmp_path / "out"), str(tmp_path / "cp2"), 1
        ).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.query_id, r.rating, r.rank) for r in found] == [(7, 1, 1)]


def test_stream_counts_copies_on_in_its_state(spark, tmp_path):
    """From an index that is there, over restarts, and without reading it again."""
    folder, path = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    batch = normalize_reviews(spark.createDataFrame([("a",), ("a",), ("b",)], "Review string"))
    add_reviews(spark, path, batch, letter_counts, "batch:0")
    for i, text in enumerate(["a\nc", "b\na\na", "c\nd"]):
        (folder / f"{i}.csv").write_text(f"Review\n{text}\n")
        stream_index(
            spark, str(folder), ["Review"], ColumnMapping(review="Review"), path, letter_counts,
            str(tmp_path / "cp"),
        ).awaitTermination()
    found = sorted((r.content, r.source_id.partition("_")[2][32:])
                   for r in read_index(spark, path).collect())
    assert found == [
        ("Review: a", ""), ("Review: a", "_2"), ("Review: a", "_3"), ("Review: a", "_4"),
        ("Review: a", "_5"), ("Review: b", ""), ("Review: b", "_2"), ("Review: c", ""),
        ("Review: c", "_2"), ("Review: d", ""),
    ]


def test_a_bucket_numbers_the_copies_of_each_digest():
    """One call sees the records of many digests, in parts."""

    class Copies(dict):
        getValue, containsKey, updateValue = dict.get, dict.__contains__, dict.__setitem__

    counter = CopyCounter()
    counter.copies = Copies()
    counter.handleInitialState(
        ("0",), pd.DataFrame({"id_digest": ["0a", "0b"], "copies": [3, 1]}), None
    )
    parts = [["0a", "0c", "0a"], ["0c", "0b", "0a", "0d"]]
    rows = [pd.DataFrame({"record": d, "id_digest": d, "bucket": "0"}) for d in parts]
    found = pd.concat(counter.handleInputRows(("0",), iter(rows), None))
    assert [*zip(found["id_digest"], found["occurrence"])] == [
        ("0a", 4), ("0c", 1), ("0a", 5), ("0c", 2), ("0b", 2), ("0a", 6), ("0d", 1)
    ]
    assert counter.copies == {("0a",): (6,), ("0b",): (2,), ("0c",): (2,), ("0d",): (1,)}


def test_files_of_many_megabytes_are_no_values(spark, tmp_path):
    """A task held several copies of a file of up to 256 MB."""
    content = b"a line of a file\n" * 1_200_000
    (tmp_path / "f.csv").write_bytes(content)
    found = file_digests(spark, str(tmp_path / "f.csv"))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert [r.digest for r in found.collect()] == [sha256(content).hexdigest()]


def test_a_question_sent_twice_is_answered_once(spark, tmp_path):
    path, asks = str(tmp_path / "index"), tmp_path / "asks"
    asks.mkdir()
    batch = normalize_reviews(spark.createDataFrame([("a",), ("b",)], "Review string"))
    add_reviews(spark, path, batch, letter_counts, "batch:0")
    lines = [
        '{"query_id": 1, "question": "a", "at": "2024-01-01T00:00:00Z"}\n',
        '{"query_id": 1, "question": "a", "at": "2024-01-01T00:10:00Z"}\n'
        '{"query_id": 2, "question": "b", "at": "2024-01-01T09:00:00Z"}\n',
        '{"query_id": 3, "question": "b", "at": "2024-01-01T00:20:00Z"}\n',
    ]
    for i, line in enumerate(lines):
        (asks / f"{i}.json").write_text(line)
        questions = spark.readStream.schema("query_id int, question string, at timestamp").json(
            str(asks)
        )
        stream_search(
            questions, path, letter_counts, str(tmp_path / "out"), str(tmp_path / "cp"), 1,
            event_time="at",
        ).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.query_id for r in found) == [1, 2]


def test_two_writers_at_once_keep_their_rows(spark, tmp_path, monkeypatch):
    """Both see the same log before they write."""
    from critiq.sources import index as I

    path = str(tmp_path / "index")
    rows = [spark.createDataFrame([(x,)], "source_id string") for x in ("a", "b", "c")]
    I.write_batch(spark, path, rows[0])
    seen = I.commits(spark, path)
    with monkeypatch.context() as m:
        m.setattr(I, "commits", lambda *_: seen)
        I.write_batch(spark, path, rows[1])
        I.write_batch(spark, path, rows[2])
    assert {r.source_id for r in read_index(spark, path).collect()} == {"a", "b", "c"}


def test_compaction_shortens_the_log(spark, tmp_path):
    from critiq.sources import index as I

    path = str(tmp_path / "index")
    for i in range(6):
        rows = spark.createDataFrame([(f"{i}", i)], "source_id string, n int")
        gone = rows.selectExpr(f"'{i - 1}' AS source_id") if i % 2 else None
        I.write_batch(spark, path, rows, gone, tag=f"t{i}")
    before = {tuple(r) for r in read_index(spark, path).collect()}
    assert I.compact_index(spark, path) == len(before) == 3
    assert len(commits(spark, path)) == 1 and I.has_tag(spark, path, "t2")
    assert {tuple(r) for r in read_index(spark, path).collect()} == before
    I.write_batch(spark, path, spark.createDataFrame([("9", 9)], "source_id string, n int"))
    assert index_count(spark, path) == 4 and len(commits(spark, path)) == 2


def test_fingerprint_of_a_snapshot_without_its_rows(spark, tmp_path):
    from critiq.operators.documents import build_documents
    from critiq.operators.identity import assign_source_ids, sum_fingerprint
    from critiq.operators.reconcile import reconcile_index
    from critiq.sources import index as I

    path = str(tmp_path / "index")
    assert I.index_fingerprint(spark, path) is None
    for texts in (["a", "a", "b"], ["a", "b", "c", "c"], ["d"], ["d", "a"]):
        reviews = normalize_reviews(spark.createDataFrame([(t,) for t in texts], "Review string"))
        documents = build_documents(assign_source_ids(reviews), keep=("digest",))
        reconcile_index(spark, path, documents, letter_counts)
        assert I.index_fingerprint(spark, path) == sum_fingerprint(reviews).head()[0]
    I.compact_index(spark, path)
    assert len(list((tmp_path / "index" / "commits").glob("*.parquet"))) == 1
    assert I.index_fingerprint(spark, path) == sum_fingerprint(reviews).head()[0]
    I.write_batch(spark, path, spark.createDataFrame([("x",)], "source_id string"))
    assert I.index_fingerprint(spark, path) is None


def test_half_written_datasets_are_written_again(spark, tmp_path):
    path, root = tmp_path / "r.csv", str(tmp_path / "store")
    path.write_text("Review\n" + "".join(f"text {i}\n" for i in range(100)))
    whole = register_dataset(spark, str(path), root)
    folder = tmp_path / "store" / "datasets" / whole.digest
    (folder / "_SUCCESS").unlink()
    for part in list(folder.glob("part-*"))[:1]:
        part.unlink()
    assert register_dataset(spark, str(path), root).review_count == 100


def test_questions_wait_for_an_index(spark, tmp_path):
    asks, path = tmp_path / "asks", str(tmp_path / "index")
    asks.mkdir()
    (asks / "1.json").write_text('{"query_id": 7, "question": "Review: ccc"}\n')
    questions = spark.readStream.schema("query_id int, question string").json(str(asks))

    def run():
        stream_search(
            questions, path, letter_counts, str(tmp_path / "out"), str(tmp_path / "cp"), 1
        ).awaitTermination()

    with pytest.raises(Exception, match="no index"):
        run()
    reconcile_index(spark, path, _docs(spark, ["ccc"]), letter_counts)
    run()
    assert [r.query_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [7]


def test_stream_checks_every_header(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    (folder / "1.csv").write_text("Stars,Comment\n5,aaa\n")
    with pytest.raises(Exception):
        stream_index(
            spark, str(folder), ["Comment", "Stars"],
            ColumnMapping(review="Comment", rating="Stars"), path, letter_counts,
            str(tmp_path / "cp"),
        ).awaitTermination()
    assert read_index(spark, path) is None
