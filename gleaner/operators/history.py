"""Question preparation: chat history, context text, attachment choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.functions import predicates as P
from gleaner.functions import text as T
from gleaner.operators.dedup import greedy_unique

_MESSAGE = "array<struct<role:string,content:string>>"


def _blocks(turns: DataFrame, greeting: str, size: int) -> DataFrame:
    kept = F.when(F.col("text") != greeting, F.struct(F.col("role"), F.col("text").alias("content")))
    return turns.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / size).cast("long").alias("block"),
                        kept.alias("message"))


def _ordered(frame_or_none=None) -> Column:
    collected = F.collect_list(F.when(F.col("message").isNotNull(), F.struct("turn", "message")))
    if frame_or_none is not None:
        collected = collected.over(frame_or_none)
    return F.transform(F.array_sort(collected), lambda x: x["message"])


def history_blocks(turns: DataFrame, greeting: str = lx.DEFAULT_PROFILE.assistant_greeting,
                   size: int = 64) -> DataFrame:
    """(conv_id, block, messages): the conversation log in runs of ``size`` turns, greeting left out."""
    return _blocks(turns, greeting, size).groupBy("conv_id", "block").agg(_ordered().alias("messages"))


def turn_history(turns: DataFrame, greeting: str = lx.DEFAULT_PROFILE.assistant_greeting,
                 size: int = 64) -> DataFrame:
    """(conv_id, turn, role, text, full_blocks, recent): all earlier messages of every turn.

    The history of a turn is the messages of blocks 0 .. full_blocks-1 of :func:`history_blocks`
    followed by ``recent``. Written this way the result grows with the number of turns, not with its
    square, and one huge conversation is spread over many groups.
    """
    earlier = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return _blocks(turns, greeting, size).withColumn("recent", _ordered(earlier)).select(
        "conv_id", "turn", "role", "text", F.col("block").alias("full_blocks"), "recent")


def prompt_messages(asked: DataFrame, turns: DataFrame, greeting: str = lx.DEFAULT_PROFILE.assistant_greeting,
                    system: Column | None = None) -> DataFrame:
    """(question_id, seq, role, content): what goes to the model for each asked turn.

    ``asked`` (question_id, conv_id, turn) and, for ``system``, further columns; ``turns`` (conv_id, turn, role, text). The system
    message comes first (seq -1), then all earlier messages of the conversation without the greeting, then the turn itself.
    The rows are the result: they grow with the histories of the asked turns only.
    """
    said = turns.where((F.col("text") != greeting) & F.col("turn").isNotNull()).select(
        "conv_id", F.col("turn").alias("_at"), "role", F.col("text").alias("content"))
    told = asked.select("question_id", "conv_id", "turn").join(said, "conv_id").where(F.col("_at") <= F.col("turn")).select(
        "question_id", F.col("_at").cast("long").alias("seq"), "role", "content")
    if system is None:
        return told
    return told.unionByName(asked.select("question_id", F.lit(-1).cast("long").alias("seq"), F.lit("system").alias("role"),
                                         system.alias("content")))


def messages_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def context_texts(hits: DataFrame) -> DataFrame:
    """(question_id, context) from ranked chunks (question_id, position, title, url, chunk_text)."""
    block = F.concat(F.lit("출처: "), T.text_or_empty(F.col("title")), F.lit(" (URL: "), T.text_or_empty(F.col("url")),
                     F.lit(")\n내용: "), T.text_or_empty(F.col("chunk_text")))
    ordered = F.array_sort(F.collect_list(F.struct("position", block.alias("block"))))
    return hits.groupBy("question_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def prompt_inputs(questions: DataFrame, hits: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per question: question text, context (empty without hits) and, if given, its history.

    ``questions`` (question_id, text); ``history`` (question_id, full_blocks, recent).
    """
    out = questions.select("question_id", "text").join(context_texts(hits), "question_id", "left") \
        .withColumn("context", T.text_or_empty(F.col("context")))
    if history is None:
        return out
    none = F.array().cast(_MESSAGE)
    return out.join(history.select("question_id", "full_blocks", "recent"), "question_id", "left") \
        .withColumn("recent", F.coalesce("recent", none))


# -- attachments ------------------------------------------------------------------------------


def chunk_files(hits: DataFrame, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> DataFrame:
    """(question_id, files) offered by the retrieved chunks, in rank and text order.

    ``hits`` (question_id, question, position, page_type, title, chunk_text). A link counts if its page
    type offers files, it points to a file of the office, and a question word of two or more letters occurs
    in its label or the chunk title (always, for passport pages).
    """
    words = F.filter(F.split(T.clean_inline(F.col("question")), " "), lambda w: F.length(w) > 1)
    title, kind = T.text_or_empty(F.col("title")), T.text_or_empty(F.col("page_type"))

    def wanted(link):
        named = F.exists(words, lambda w: link["label"].contains(w) | title.contains(w))
        return P.is_own_file_link(link["url"], profile) & (named | kind.contains("passport"))

    links = F.filter(T.markdown_links(F.col("chunk_text")), wanted)
    found = hits.where(P.offers_attachments(F.col("page_type"))).select(
        "question_id", "position", F.transform(links, lambda x: F.struct(
            T.strip(x["label"]).alias("file_name"), T.strip(x["url"]).alias("file_url"))).alias("files"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "files")))
    return found.groupBy("question_id").agg(F.flatten(F.transform(ordered, lambda x: x["files"])).alias("files"))


def mentioned_files(question: Column, answer: Column, names=lx.LOCAL_FILES, folder: str = lx.LOCAL_FILE_FOLDER
                    ) -> Column:
    """Files of the local catalogue whose name occurs in the answer or the question."""
    catalogue = F.array(*[F.struct(F.lit(n).alias("name")) for n in names])
    named = F.filter(catalogue, lambda f: T.text_or_empty(answer).contains(f["name"])
                     | T.text_or_empty(question).contains(f["name"]))
    return F.transform(named, lambda f: F.struct(
        F.concat(f["name"], F.lit(".pdf")).alias("file_name"),
        F.concat(F.lit(folder), f["name"], F.lit(".pdf")).alias("file_url")))


def pick_attachments(questions: DataFrame, hits: DataFrame, profile: lx.SiteProfile = lx.DEFAULT_PROFILE
                     ) -> DataFrame:
    """(question_id, files): files of chunks and of the catalogue, greedily unique by url and by name.

    ``questions`` (question_id, text, answer, maybe rewritten); without an answer column pass null. Files of chunks are measured by the
    rewritten question, if there is one; mentions count in the question as it was asked.
    """
    refined = F.coalesce("rewritten", "text") if "rewritten" in questions.columns else F.col("text")
    asked = questions.select("question_id", F.col("text").alias("question"), "answer", refined.alias("refined"))
    offered = hits.join(asked.select("question_id", F.col("refined").alias("question")), "question_id")
    files = asked.join(chunk_files(offered, profile), "question_id", "left")
    none = F.array().cast("array<struct<file_name:string,file_url:string>>")
    every = F.concat(F.coalesce("files", none), mentioned_files(F.col("question"), F.col("answer")))
    return files.select("question_id", greedy_unique(every).alias("files"))
