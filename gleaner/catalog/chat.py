"""Question preparation over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.catalog import query
from gleaner.catalog import sqltext as q
from gleaner.catalog.searches import _HYBRID, chunks, questions
from gleaner.functions import text as T
from gleaner.operators import history as H
from gleaner.operators import search as S

_TALK = "(text || ' 처리 3 ~ 5일, **2-3주** `코드` [안내(' || role || ').pdf](https://a.kr/f?x=' || turn || ') ' || chr(10) || " \
        "'## 제목' || chr(10) || '- 항목 https://b.kr/z ![그림](/i.png) [접기[1]](/download/' || conv_id || ') 📞')"


def _talk():
    return F.concat(
        F.col("text"), F.lit(" 처리 3 ~ 5일, **2-3주** `코드` [안내("), "role", F.lit(").pdf](https://a.kr/f?x="),
        F.col("turn").cast("string"), F.lit(") \n## 제목\n- 항목 https://b.kr/z ![그림](/i.png) [접기[1]](/download/"),
        F.col("conv_id").cast("string"), F.lit(") 📞"))


def _spoken_sql(x):
    for pattern, to in T.spoken_rules():
        # RE2 spells the code points and the vertical tab differently
        pattern = pattern.replace("\\x85", "\\x{85}\\x0b")
        x = q.sub(x, pattern, q.lit(to.replace("$1", "\\1").replace("$2", "\\2")))
    return q.strip(x)


@query(f"select conv_id, turn, {_spoken_sql(_TALK)} as spoken from conversations")
def spoken_text(t):
    return t("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"),
                                     T.spoken_text(_talk()).alias("spoken"))


@query(f"""with c as (select conv_id, turn, {_TALK} as x from conversations),
  l as (select conv_id, turn, unnest(range(len(regexp_extract_all(x, {q.rx(lx.MARKDOWN_LINK)})))) as n,
    unnest(regexp_extract_all(x, {q.rx(lx.MARKDOWN_LINK)}, 1)) as label,
    unnest(regexp_extract_all(x, {q.rx(lx.MARKDOWN_LINK)}, 2)) as url from c)
  select conv_id, turn, n, label, url from l""")
def markdown_links(t):
    rows = t("conversations").select("conv_id", "turn", F.posexplode(T.markdown_links(_talk())).alias("n", "l"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("n").cast("long").alias("n"), "l.label",
                       "l.url")


_GREETING = "Éenai."
_BLOCK = 2
_BLOCKS = (f"b as (select conv_id, turn, role, text, turn // {_BLOCK} as block, case when role <> 'system' then "
           "role || ': ' || text end as message from conversations)")


_BLOCKS_64 = _BLOCKS.replace(f"turn // {_BLOCK}", "turn // 64")


def _turns(t):
    # system turns stand for the fixed greeting
    greeted = F.when(F.col("role") == "system", F.lit(_GREETING)).otherwise(F.col("text"))
    return t("conversations").withColumn("text", greeted)


@query(f"""with {_BLOCKS} select conv_id, turn, role, block as full_blocks,
  coalesce(string_agg(message, chr(10) order by turn) over (partition by conv_id, block order by turn
    rows between unbounded preceding and 1 preceding), '') as recent from b""".replace(
    "string_agg(message, chr(10) order by turn) over", "string_agg(message, chr(10)) over"))
def chat_history(t):
    h = H.turn_history(_turns(t), _GREETING, _BLOCK)
    return h.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "full_blocks",
                    H.messages_text(F.col("recent")).alias("recent"))


@query(f"""with {_BLOCKS_64} select conv_id, turn, role, block as full_blocks,
  coalesce(string_agg(message, chr(10) order by turn) over (partition by conv_id, block order by turn
    rows between unbounded preceding and 1 preceding), '') as recent from b""".replace(
    "string_agg(message, chr(10) order by turn) over", "string_agg(message, chr(10)) over"))
def chat_history_default(t):
    """The same with the default block of 64 turns."""
    h = H.turn_history(_turns(t), _GREETING)
    return h.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "full_blocks",
                    H.messages_text(F.col("recent")).alias("recent"))


@query(f"""with a as (select conv_id * 1000 + turn as question_id, conv_id, turn, text from conversations where role = 'user'),
  g as (select * from conversations where role <> 'system' and text is not null)
  select question_id, -1 as seq, 'system' as role, 'Context: ' || text as content from a
  union all select question_id, g.turn, g.role, g.text from a join g on g.conv_id = a.conv_id and g.turn <= a.turn""")
def prompt_messages(t):
    """All messages sent with every user turn, the system message first."""
    asked = t("conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "conv_id", "turn", "text")
    return H.prompt_messages(asked, _turns(t), _GREETING, F.concat(F.lit("Context: "), "text"))


@query(f"""with {_BLOCKS} select conv_id, block, coalesce(string_agg(message, chr(10) order by turn), '') as messages
  from b group by 1, 2""")
def history_blocks(t):
    h = H.history_blocks(_turns(t), _GREETING, _BLOCK)
    return h.select("conv_id", "block", H.messages_text(F.col("messages")).alias("messages"))


@query(f"""with {_HYBRID}, x as (select question_id, string_agg('출처: ' || source || ' (URL: ' || lang || ')' || chr(10) || '내용: '
    || text, chr(10) || chr(10) order by position) as context from g join documents on doc_id = chunk_id
    where position <= {lx.TOP_K} group by 1)
  select question_id, text, coalesce(context, '') as context from q left join x using (question_id)""")
def prompt_input(t):
    asked = questions(t)
    hits = S.hybrid_top_k(asked, chunks(t))
    docs = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"),
                                 F.col("lang").alias("url"), F.col("text").alias("chunk_text"))
    return H.prompt_inputs(asked, hits.join(docs, "chunk_id"))


# a third of the pages are passport pages, a third are forms whose links need a word of the rewritten question (here: all but its first
# word) in their label or title (here: the whole text), a third offer nothing; every third question names a form itself
_OFFERED = ("flatten(list(list_filter([{'n': '서식' || lang, 'u': '/download/' || doc_id}, {'n': '안내', 'u': '/download/' || doc_id}], "
            "lambda f: doc_id % 3 = 0 or doc_id % 3 = 1 and len(list_filter(words, lambda w: contains(f.n, w) "
            "or contains(d.text, w))) > 0) order by position))")


@query(f"""with {_HYBRID}, qw as (select question_id, list_filter(string_split({q.inline(q.sub('text', '^[^ ]+ *', chr(39) * 2))}, ' '), lambda w: length(w) > 1) as words from q),
  found as (select question_id, {_OFFERED} as files
    from g join documents d on doc_id = chunk_id join qw using (question_id) where position <= {lx.TOP_K} group by 1),
  offered as (select question_id, list_concat(coalesce(files, []), list_concat(
    [{{'n': '여권발급신청서.pdf', 'u': '/download/passport_pdfs/여권발급신청서.pdf'}}], case when question_id % 3 = 0 then
    [{{'n': '법정대리인동의서.pdf', 'u': '/download/passport_pdfs/법정대리인동의서.pdf'}}] else [] end)) as files from q left join found using (question_id)),
  picked as (select question_id, {q.greedy('files')} as kept from offered)
  select question_id, len(kept) as n_files, array_to_string(list_transform(kept, lambda f: f.n || '@' || f.u), chr(10)) as files from picked""")
def attachment_pick(t):
    """Files offered by the retrieved documents (links laid into their texts) and by mention."""
    asked = questions(t)
    hits = S.hybrid_top_k(asked, chunks(t))
    i = F.col("doc_id").cast("string")
    text = F.concat(F.col("text"), F.lit(" [ 서식"), "lang", F.lit("](/download/"), i, F.lit(") [서식](https://x.kr/"), i,
                    F.lit(") [안내](/download/"), i, F.lit(")"))
    kind = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("passport "), "lang")).when(F.col("doc_id") % 3 == 1, "민원서식").otherwise("소식")
    docs = t("documents").select(
        F.col("doc_id").alias("chunk_id"), kind.alias("page_type"), F.col("text").alias("title"), text.alias("chunk_text"))
    named = F.when(F.col("question_id") % 3 == 0, F.concat("text", F.lit(" 법정대리인동의서"))).otherwise(F.col("text"))
    picked = H.pick_attachments(
        asked.select("question_id", named.alias("text"), F.lit("여권발급신청서를 내세요").alias("answer"),
                     F.regexp_replace("text", "^[^ ]+ *", "").alias("rewritten")),
        hits.join(docs, "chunk_id"))
    return picked.select("question_id", F.size("files").alias("n_files"), F.array_join(
        F.transform("files", lambda f: F.concat(f["file_name"], F.lit("@"), f["file_url"])), "\n").alias("files"))
