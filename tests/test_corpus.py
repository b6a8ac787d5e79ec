"""Reading, chunk building, loading, streaming and question preparation on small fixtures."""

import hashlib
import json
from pathlib import Path

import pytest
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import lexicon as lx
from gleaner.operators import history as H
from gleaner.plans.chunks import build_chunks, chunk_records
from gleaner.schemas import KINDS, chunk_schema
from gleaner.sources import chunks as C
from gleaner.sources import jsonl as J
from gleaner.streaming.load import stream_chunks


def dump(path, *records):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in records), "utf-8")
    return str(path)


@pytest.fixture()
def raw(spark, tmp_path):
    body = "신청하려면 창구에 방문하여 서식을 내시기 바랍니다"
    general = [
        {"doc_id": "g1", "url": "/g1", "title": "안내", "views": 3, "date": "2024-01-02", "department": "갑과",
         "shortcut_links": [{"text": "창구", "url": "/c"}],
         "sections": [{"heading_path": ["전체 본문"], "block_type": "full_text_backup", "text": body},
                      {"heading_path": ["가", "나"], "block_type": "paragraph", "text": body},
                      {"heading_path": [], "block_type": "list", "text": "짧음"},
                      {"heading_path": [], "block_type": "table", "text": "가 | 나 | 다 | 라 표의 내용이 깁니다"},
                      {"heading_path": [], "block_type": "list", "text": "두 번째 구역의 글은 충분히 깁니다"}]},
        {"doc_id": "g2", "url": "/g2", "views": "", "sections": [
            {"heading_path": ["다"], "block_type": "paragraph", "text": "창구에 방문하여 서식을 내시기"},
            {"heading_path": ["다"], "block_type": "paragraph", "text": body.replace(" ", "  ")}]},
        {"doc_id": "g3", "page_type": "menu_shortcut", "title": "바로"}]
    civil = [{"doc_id": "c1", "title": "전입", "text": "가" * 80, "fee": "무료", "notes": " ", "department": "",
              "attachments": [{"filename": "a.hwp", "file_url": "/a"}, {"filename": "b", "file_url": " "}]},
             {"doc_id": "c2", "text": "짧음"}]
    waste = [{"doc_id": "w1", "url": "/w", "menu_path": ["분야별정보", "폐기물"], "sections": [
        {"heading_path": ["폐기물", "배출"], "block_type": "list", "text": "Home > x\n 종이는 묶기 \n\n"},
        {"heading_path": [], "block_type": "list", "text": "닫기"}]}]
    return {"general": dump(tmp_path / "g.jsonl", *general, "", "  "), "civil": dump(tmp_path / "c.jsonl", *civil),
            "bid": str(tmp_path / "absent.jsonl"), "waste": dump(tmp_path / "w.jsonl", *waste)}


def test_chunks_of_all_kinds(spark, raw):
    got = {r.chunk_id: r for r in build_chunks(J.read_raw(spark, raw), office="구청").collect()}
    assert set(got) == {"g1_0", "g1_1", "c1_0", "w1_0"}
    assert got["g1_0"].chunk_text == "# 가 > 나\n\n신청하려면 [창구](/c)에 방문하여 서식을 내시기 바랍니다"
    assert (got["g1_0"].views, str(got["g1_0"].published_at), got["g1_0"].author) == (3, "2024-01-02", "갑과")
    assert got["g1_1"].chunk_text.startswith("# 안내\n\n두 번째")
    assert got["c1_0"].chunk_text.startswith("제목: 전입\n담당부서:  (문의처: 안내번호)\n처리기간: 지체 없이 | 수수료: 무료\n제출처: 해당")
    assert got["c1_0"].chunk_text.endswith("📄 **구청 원본 서식 다운로드**\n- [a.hwp](/a)")
    assert got["c1_0"].author == "담당부서 미지정"
    assert got["w1_0"].chunk_text == "# 폐기물 > 배출\n종이는 묶기"
    assert got["w1_0"].text_hash == hashlib.md5(got["w1_0"].chunk_text.encode()).hexdigest()
    assert got["g1_0"].source == lx.DEFAULT_PROFILE.source


def test_pieces_are_numbered_where_they_are(spark, raw):
    """Only pieces of documents that share order and id move to be counted."""
    docs = J.read_raw(spark, raw)
    for kind in ("civil", "waste"):
        plan = build_chunks({kind: docs[kind]})._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    twice = {kind: rows.unionByName(rows) for kind, rows in docs.items()}
    got = sorted(r.chunk_id for r in build_chunks(twice).collect())
    assert got == ["c1_0", "c1_1", "g1_0", "g1_1", "g1_2", "g1_3", "w1_0", "w1_1"]


def test_corpus_keeps_lines_of_one_kind_at_a_time(spark, monkeypatch):
    from gleaner.catalog import QUERIES, load_all

    load_all()
    here, drop = [], J.drop_lines

    def dropped(session, path):
        here.append(sorted(p.name for p in Path(path).parent.iterdir()))
        drop(session, path)

    monkeypatch.setattr(J, "drop_lines", dropped)
    QUERIES["corpus_build"](spark, SF).count()
    assert here == [["chunks", kind] if kind > "chunks" else [kind, "chunks"] for kind in KINDS]


def test_lines_tolerant_and_strict(spark, tmp_path):
    path = dump(tmp_path / "x.jsonl", {"doc_id": "a", "views": 1}, "", "{broken", {"doc_id": "b", "views": None})
    from gleaner.schemas import raw_schema

    good, bad = J.read_lines(spark, path, raw_schema("waste"))
    assert {(r.doc_id, r.views) for r in good.collect()} == {("a", "1"), ("b", None)}
    assert [r.line for r in bad.collect()] == ["{broken"]
    with pytest.raises(Exception, match="(?i)malformed"):
        J.read_lines(spark, path, raw_schema("waste"), strict=True)[0].collect()


def test_written_lines_keep_nulls(spark, raw, tmp_path):
    made = chunk_records(build_chunks(J.read_raw(spark, raw)))
    J.write_lines(made, str(tmp_path / "out"))
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert all(list(x) == chunk_schema().names and x["embedding"] is None and x["major"] is None for x in lines)
    assert J.read_chunks(spark, str(tmp_path / "out")).count() == made.count()


def test_documents_of_two_kinds_in_one_output(spark, tmp_path):
    docs = spark.createDataFrame([("a", "contents", "x")], "doc_id string, page_type string, text string")
    links = spark.createDataFrame([("b", "menu_shortcut", "/u")], "doc_id string, page_type string, shortcut_url string")
    J.write_documents(docs, links, str(tmp_path / "docs"))
    back = spark.read.json(str(tmp_path / "docs"))
    assert {(r.doc_id, r.page_type, r.shortcut_url) for r in back.collect()} == {("a", "contents", None), ("b", "menu_shortcut", "/u")}


def test_stream_loads_once(spark, tmp_path):
    table, folder, state = (str(tmp_path / x) for x in ("table", "in", "state"))
    (tmp_path / "in").mkdir()
    C.rebuild_table(spark, table)

    def run():
        stream_chunks(spark, folder, table, state, embed=lambda text: F.array(F.length(text).cast("float"))).awaitTermination()
        return {(r.chunk_id, r.chunk_text, tuple(r.embedding)) for r in C.read_table(spark, table).collect()}

    dump(tmp_path / "in" / "1.json", {"chunk_id": "a", "chunk_text": " one "}, {"chunk_id": "a", "chunk_text": "  "}, {"chunk_text": "no id"},
         {"chunk_id": "b", "chunk_text": " "}, "", "{bad")
    assert run() == {("a", "one", (3.0,))}
    dump(tmp_path / "in" / "2.json", {"chunk_id": "a", "chunk_text": "again"}, {"chunk_id": "b", "chunk_text": "two"})
    assert run() == {("a", "one", (3.0,)), ("b", "two", (3.0,))}
    assert len(run()) == 2


def test_replayed_batch_adds_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    C.rebuild_table(spark, table)
    names = chunk_schema()
    rows = spark.createDataFrame([{"chunk_id": "a", "chunk_text": "x"}], names).withColumn("ord", F.lit(1))
    for _ in range(2):
        C.load_chunks(rows, table, "ord")
    loaded = C.read_table(spark, table).collect()
    assert len(loaded) == 1 and loaded[0].title == "정보 없음" and loaded[0].page_type == "contents"


def test_a_load_reads_only_the_buckets_of_its_ids(spark, tmp_path):
    table = str(tmp_path / "t")
    C.rebuild_table(spark, table, buckets=32)
    schema = T.StructType([*chunk_schema().fields, T.StructField("ord", T.LongType())])

    def drop(ids):
        return spark.createDataFrame([{"chunk_id": f"c{i}", "chunk_text": f"text {i}", "ord": i} for i in ids], schema)

    C.load_chunks(drop(range(500)), table, "ord", buckets=32)
    assert C.table_buckets(spark, table) == 32
    incoming = drop([3, 700, 701])
    read = {f.split("bucket=")[1].split("/")[0] for f in C.known_ids(incoming, table, 32).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    wanted = {r[0] for r in incoming.select(C._bucket("chunk_id", 32)).collect()}
    assert read <= wanted and len(wanted) <= 3 and C.known_ids(incoming, table, 32).where("chunk_id = 'c3'").count() == 1
    # another number of buckets does not split the table in two
    C.load_chunks(incoming, table, "ord", buckets=7)
    C.load_chunks(incoming.where("chunk_id is null"), table, "ord")
    got = [r.chunk_id for r in C.read_table(spark, table).collect()]
    assert sorted(got) == sorted(f"c{i}" for i in [*range(500), 700, 701])


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "chunk_id string, text_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1")], "chunk_id string, text_hash string")
    assert {tuple(r) for r in C.detect_changes(old, new).collect()} == {
        ("a", "same"), ("b", "changed"), ("c", "same"), ("d", "gone"), ("e", "new")}


@pytest.mark.parametrize("size", [1, 2, 3, 64])
def test_history_blocks_rebuild_every_history(spark, size):
    greeting = lx.DEFAULT_PROFILE.assistant_greeting
    turns = [(c, i, "assistant" if i % 2 == 0 else "user", greeting if i == 0 else f"{c}-{i}") for c in (1, 2) for i in range(7)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string")
    blocks = {(r.conv_id, r.block): [m.content for m in r.messages] for r in H.history_blocks(df, size=size).collect()}
    rows = H.turn_history(df, size=size).collect()
    assert len(rows) == len(turns)
    for r in rows:
        full = [m for b in range(r.full_blocks) for m in blocks[r.conv_id, b]] + [m.content for m in r.recent]
        assert full == [t for c, i, _, t in turns if c == r.conv_id and i < r.turn and t != greeting]


def test_attachment_choice(spark):
    asked = spark.createDataFrame([(1, "여권 서식 줘", "여권발급신청서를 쓰세요"), (2, "x", None)], "question_id int, text string, answer string")
    text = "[ 여권 A](/download/a) [다른](/download/b) [여권 B](https://away.kr/c) [여권 A](/download/d)"
    hits = spark.createDataFrame([(1, 1, "민원서식(civil_form)", "제목", text), (1, 2, "contents", "여권", text), (2, 1, "passport", "t", text)],
                                 "question_id int, position int, page_type string, title string, chunk_text string")
    got = {r.question_id: [tuple(f) for f in r.files] for r in H.pick_attachments(asked, hits).collect()}
    assert got[1] == [("여권 A", "/download/a"), ("여권발급신청서.pdf", "/download/passport_pdfs/여권발급신청서.pdf")]
    assert got[2] == [("여권 A", "/download/a"), ("다른", "/download/b")]


def test_context_follows_rank(spark):
    hits = spark.createDataFrame([(1, 2, "B", "/b", "둘"), (1, 1, "A", "/a", "하나")],
                                 "question_id int, position int, title string, url string, chunk_text string")
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "question_id int, text string")
    got = {r.question_id: r.context for r in H.prompt_inputs(asked, hits).collect()}
    assert got == {1: "출처: A (URL: /a)\n내용: 하나\n\n출처: B (URL: /b)\n내용: 둘", 2: ""}
