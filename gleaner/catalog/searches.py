"""Retrieval: benchmark items are the questions (vector ``vec_id = item_id``), documents the chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.catalog import query
from gleaner.operators import listing
from gleaner.operators import search as S

_QUESTIONS = "q as (select item_id as question_id, b.text, e.embedding::double[] as v from benchmark b " \
             "left join embeddings e on e.vec_id = b.item_id)"
_CHUNKS = "c as (select doc_id as chunk_id, d.text, e.embedding::double[] as v from documents d " \
          "left join embeddings e on e.vec_id = d.doc_id)"


def _vectors(t):
    return t("embeddings").select(F.col("vec_id"), "embedding")


def questions(t):
    v = _vectors(t)
    return t("benchmark").join(v, F.col("item_id") == F.col("vec_id"), "left").select(
        F.col("item_id").alias("question_id"), "text", "embedding")


def chunks(t):
    v = _vectors(t)
    return t("documents").join(v, F.col("doc_id") == F.col("vec_id"), "left").select(
        F.col("doc_id").alias("chunk_id"), "text", "embedding")


_ALL = "e as (select vec_id, embedding::double[] as v from embeddings)"
_PAIRS = (f"{_ALL}, p as (select a.vec_id as question_id, b.vec_id as chunk_id, "
          "round(1 - list_cosine_similarity(a.v, b.v), 12) as d from benchmark join e a on a.vec_id = item_id cross join e b)")


def _asked(t):
    """Vectors of the benchmark's questions."""
    v = _vectors(t)
    return v.join(t("benchmark"), F.col("vec_id") == F.col("item_id"), "left_semi").withColumnRenamed("vec_id", "question_id")


@query(f"""with {_PAIRS}, r as (select *, row_number() over (partition by question_id order by d, chunk_id) as rank from p)
  select question_id, chunk_id, round(d, 9) as distance, rank from r where rank <= {lx.TOP_K}""")
def vector_topk(t):
    """The nearest vectors of every benchmark question."""
    v = _vectors(t)
    found = S.vector_top_k(_asked(t), v.withColumnRenamed("vec_id", "chunk_id"))
    return found.select("question_id", "chunk_id", F.round("distance", 9).alias("distance"),
                        F.col("rank").cast("long").alias("rank"))


@query(f"""with {_PAIRS}, r as (select *, row_number() over (partition by question_id order by d, chunk_id) as rank from p
    where d < {lx.DISTANCE_LIMIT})
  select question_id, chunk_id, round(d, 9) as distance, rank from r where rank <= {lx.THRESHOLD_TOP_K}""")
def vector_threshold(t):
    """The same through the block join that serves question sets too large for one task."""
    v = _vectors(t)
    found = S.vector_top_k(_asked(t), v.withColumnRenamed("vec_id", "chunk_id"),
                           lx.THRESHOLD_TOP_K, lx.DISTANCE_LIMIT, question_rows=15, block_rows=300)
    return found.select("question_id", "chunk_id", F.round("distance", 9).alias("distance"),
                        F.col("rank").cast("long").alias("rank"))


def _words(x):
    return (f"list_distinct(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))")


# questions are whole benchmark texts, passages of which stand in some documents
_MATCHED = (f"w as (select question_id, {_words('text')} as terms from q), "
            f"h as (select chunk_id, {_words('text')} as words from c), "
            "m as (select question_id, chunk_id from w join h on list_has_all(words, terms) where len(terms) > 0)")


@query(f"""with q as (select item_id as question_id, text from benchmark),
    c as (select doc_id as chunk_id, text from documents), {_MATCHED},
    r as (select *, row_number() over (partition by question_id order by chunk_id) as rank from m)
  select question_id, chunk_id, rank from r where rank <= {lx.TOP_K}""")
def keyword_match(t):
    asked = t("benchmark").select(F.col("item_id").alias("question_id"), "text")
    docs = t("documents").select(F.col("doc_id").alias("chunk_id"), "text")
    found = S.keyword_top_k(asked, docs)
    return found.select("question_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


_HYBRID = f"""{_QUESTIONS},
  {_CHUNKS}, {_MATCHED},
  d as (select question_id, chunk_id, round(1 - list_cosine_similarity(q.v, c.v), 12) as d from q cross join c
    where q.v is not null and c.v is not null),
  vr as (select question_id, chunk_id, row_number() over (partition by question_id order by d, chunk_id) as r from d),
  kr as (select question_id, chunk_id, row_number() over (partition by question_id order by chunk_id) as r from m),
  u as (select question_id, chunk_id, 1 / (60.0::double + r) as s, r as v, null::bigint as k from vr where r <= {lx.TOP_K}
    union all select question_id, chunk_id, 1 / (60.0::double + r), null, r from kr where r <= {lx.TOP_K}),
  f as (select question_id, chunk_id, sum(s) as score, min(v) as v, min(k) as k from u group by 1, 2),
  g as (select *, row_number() over (partition by question_id order by score desc, v nulls last, k nulls last) as position
    from f)"""


@query(f"with {_HYBRID} select question_id, chunk_id, round(score, 9) as score, position from g where position <= {lx.TOP_K}")
def hybrid_search(t):
    found = S.hybrid_top_k(questions(t), chunks(t))
    return found.select("question_id", "chunk_id", F.round("score", 9).alias("score"),
                        F.col("position").cast("long").alias("position"))


# -- notices and listings ---------------------------------------------------------------------

_NOTICES = ("n as (select d.doc_id as id, 'T ' || source as title, text as chunk_text, "
            "case when l.quality = 1 then n_chars end as views, date '2024-01-01' + (d.doc_id % 365)::int as published_at "
            "from documents d left join labels l on l.doc_id = d.doc_id)")


def _notices(t):
    return t("documents").join(t("labels"), "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("T "), "source").alias("title"), F.col("text").alias("chunk_text"),
        F.when(F.col("quality") == 1, F.col("n_chars")).alias("views"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("published_at"))


def _day():
    return F.col("published_at").cast("string").alias("published_at")


@query(f"""with {_NOTICES} select id, views from n where contains(title, 'the') or contains(chunk_text, 'the')""")
def notice_search(t):
    return S.search_notices(_notices(t), "the", "views").select("id", "views")


@query(f"""with {_NOTICES} select id, views, published_at::varchar as published_at from n where contains(title, 'the') or contains(chunk_text, 'the')""")
def notice_search_newest(t):
    return S.search_notices(_notices(t), "the").select("id", "views", _day())


@query(f"""with {_NOTICES} select id, views from n""")
def notice_most_viewed(t):
    return S.search_notices(_notices(t), None, "views").select("id", "views")


@query(f"with {_NOTICES} select id, title, views from n order by id limit 10 offset 20")
def notice_page(t):
    return S.read_notices(_notices(t), 20, 10).select("id", "title", "views")


@query(f"with {_NOTICES} select id, title, views from n where id > 29 order by id limit 10")
def notice_next_page(t):
    """The page behind the last id of another one."""
    return S.notices_after(_notices(t), 29, 10).select("id", "title", "views")


@query(f"with {_NOTICES} select id, title, views, published_at::varchar as published_at from n where id = 7")
def notice_by_id(t):
    return S.read_notice(_notices(t), 7).select("id", "title", "views", _day())


# boards are order priorities; a board's pages are its months, newest first and numbered from 1. The first board lacks its
# fourth page, the second has only old rows on its third, the third has undated rows among the others. The date rule knows years from
# 2000 on, so rows of earlier years count as undated.
_LISTED = ("m as (select o_orderpriority as board, year(o_orderdate) * 12 + month(o_orderdate) as month, o_orderdate::date as day, "
           "o_orderkey from orders), r as (select *, max(month) over (partition by board) - month + 1 as page_no from m), "
           "o as (select board, page_no, o_orderkey, case when board like '2%' and page_no = 3 then date '2000-01-02' "
           "when board like '3%' and o_orderkey % 3 = 0 or year(day) < 2000 then null else day end as day from r "
           "where not (board like '1%' and page_no = 4))")


def _listed(t):
    d, board = F.col("o_orderdate"), F.col("o_orderpriority")
    month = F.year(d) * 12 + F.month(d)
    newest = t("orders").groupBy("o_orderpriority").agg(F.max(month).alias("newest"))
    rows = t("orders").join(F.broadcast(newest), "o_orderpriority").withColumn("page_no", (F.col("newest") - month + 1).cast("long"))
    third = board.startswith("2") & (F.col("page_no") == 3)
    undated = board.startswith("3") & (F.col("o_orderkey") % 3 == 0)
    date = F.when(third, "2000.01.02").when(undated, "").otherwise(F.date_format(d, "yyyy.MM.dd"))
    return rows.where(~(board.startswith("1") & (F.col("page_no") == 4))).select(
        board.alias("board"), "page_no", date.alias("date"), "o_orderkey")


@query(f"""with {_LISTED}, k as (select *, day is null or day >= date '2001-06-15' - 365 as recent from o),
  p as (select board, page_no, bool_or(recent) as any_recent from k group by 1, 2),
  n as (select *, page_no = row_number() over w as dense, coalesce(bool_or(not any_recent) over (partition by board order by page_no
    rows between unbounded preceding and 1 preceding), false) as ended from p window w as (partition by board order by page_no))
  select board, page_no, o_orderkey from k join n using (board, page_no) where recent and dense and not ended""")
def listing_stop(t):
    """Recent rows of every board up to the end of its listing."""
    kept = listing.kept_listing_rows(_listed(t), "2001-06-15", 365)
    return kept.select("board", "page_no", "o_orderkey")


@query("""select d.doc_id, coalesce(nullif(case l.quality when 1 then 'good' when 0 then '' end, ''), d.lang) as title,
  d.source as department, coalesce(l.toxic, d.n_chars) as views
  from documents d left join labels l on l.doc_id = d.doc_id""")
def overlay_meta(t):
    pages = t("documents").select("doc_id", F.col("lang").alias("title"), F.col("source").alias("department"),
                                  F.col("n_chars").alias("views"))
    rows = t("labels").select(
        "doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("title"),
        F.lit(None).cast("string").alias("department"), F.col("toxic").cast("long").alias("views"))
    return listing.overlay_listing(pages, rows, "doc_id", ("title", "department"), ("views",))
