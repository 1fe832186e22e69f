"""Context, citations, images, history and prompts for a table of ranked results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import DEFAULTS

BUDGET, HISTORY, MESSAGE_CHARS = DEFAULTS.context_tokens, DEFAULTS.history, DEFAULTS.message_chars


def within_budget(results: DataFrame, query: str, tokens: str = "tokens", budget: int = BUDGET) -> DataFrame:
    """The results of each query, in rank order, up to the first that would pass the budget."""
    total = F.sum(tokens).over(Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("running", total).where(F.col("running") <= budget)


def source_block(n: Column, title: Column, section: Column, text: Column, url: Column | None = None) -> Column:
    head = [F.lit("[Source "), n.cast("string"), F.lit("]\nPage: "), title, F.lit("\nSection: "), section]
    if url is not None:
        head += [F.lit("\nURL: "), url]
    return F.concat(*head, F.lit("\n"), text)


def joined(results: DataFrame, query: str, block: Column, between: str = "\n---\n", alias: str = "context", more: list[Column] | None = None) -> DataFrame:
    """One text a query: the blocks by rank; and more aggregates of its rows."""
    listed = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return results.groupBy(query).agg(F.array_join(F.transform(listed, lambda s: s["block"]), between).alias(alias), *(more or []))


def citations(results: DataFrame, query: str) -> DataFrame:
    """(query, id, page_title, page_url, section, cited_text): ids count from 1 by rank."""
    n = F.row_number().over(Window.partitionBy(query).orderBy("rank"))
    return results.select(query, n.alias("id"), "page_title", "page_url", F.col("section_heading").alias("section"), T.cited_text(F.col("text")).alias("cited_text"))


def gathered_images(results: DataFrame, query: str, images: str = "images") -> DataFrame:
    """The images of each query's results, distinct as whole entries, in the order first seen, without empty URLs; position counts from 1."""
    each = results.select(query, "rank", F.posexplode(images).alias("nth", "image")).where(F.coalesce(F.col("image.url"), F.lit("")) != "")
    first = each.groupBy(query, "image").agg(F.min(F.struct("rank", "nth")).alias("seen"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("seen"))
    return first.select(query, place.alias("position"), "image")


def images_by_url(images: DataFrame, query: str) -> DataFrame:
    """One entry a URL: at the place of the first, with the value of the last."""
    return images.groupBy(query, F.col("image.url").alias("url")).agg(F.min("position").alias("position"), F.max_by("image", "position").alias("image"))


def inline_images(answers: DataFrame, images: DataFrame, query: str, answer: str = "answer") -> DataFrame:
    """(query, nth, image): what image:N in an answer refers to; numbers without an image are left out."""
    numbers = F.transform(F.regexp_extract_all(F.col(answer), F.lit(r"image:(\d+)"), F.lit(1)), lambda n: n.cast("int"))
    asked = answers.select(query, F.posexplode(numbers).alias("nth", "position"))
    return asked.join(images, [query, "position"]).select(query, "nth", "image")


def recent_history(messages: DataFrame, conversation: str, turn: str, size: int = HISTORY) -> DataFrame:
    """The last size messages before the last one."""
    back = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(turn)))
    return messages.withColumn("back", back).where((F.col("back") > 1) & (F.col("back") <= size + 1)).drop("back")


def regenerated(messages: DataFrame, conversation: str, turn: str, role: str = "role") -> DataFrame:
    """What stays before the last user message when an answer is made anew."""
    last = messages.where(F.col(role) == "user").groupBy(conversation).agg(F.max(turn).alias("last_user"))
    return messages.join(last, conversation).where(F.col(turn) < F.col("last_user")).drop("last_user")


def prompt(history: DataFrame, questions: DataFrame, conversation: str, turn: str, system: str) -> DataFrame:
    """(conversation, messages array<struct<role, content>>): system, history by turn, then question and sources."""
    said = history.groupBy(conversation).agg(F.transform(F.array_sort(F.collect_list(F.struct(turn, "role", "text"))), lambda s: F.struct(s["role"].alias("role"), s["text"].alias("content"))).alias("said"))
    asked = F.struct(F.lit("user").alias("role"), F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nSources:\n"), F.coalesce("context", F.lit(""))).alias("content"))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    both = questions.join(said, conversation, "left")
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return both.select(conversation, F.concat(first, F.coalesce("said", empty), F.array(asked)).alias("messages"))


def with_reasoning(answer: Column, reasoning: Column) -> Column:
    return F.when(F.coalesce(reasoning, F.lit("")) != "", F.concat(F.lit("<think>"), reasoning, F.lit("</think>\n\n"), answer)).otherwise(answer)


def extractive(question: Column, context: Column) -> Column:
    """The default answerer, without a model: the context's sentence that shares most words with the question, and its first source."""
    words = F.array_distinct(T.query_terms(question))
    each = F.transform(T.sentences(context), lambda s: F.struct(F.size(F.array_intersect(T.tokens(s), words)).alias("n"), s.alias("s")))
    best = F.array_max(F.transform(each, lambda x: F.struct(x["n"].alias("n"), (-F.length(x["s"])).alias("l"), x["s"].alias("s"))))
    return F.when(F.size(each) > 0, F.concat(best["s"], F.lit(" [1]"))).otherwise("")


def answered(questions: DataFrame, answer: Callable[[Column, Column], Column] = extractive) -> DataFrame:
    """Adds answer to rows with question and context; answer is any function of the two columns."""
    return questions.withColumn("answer", answer(F.col("question"), F.col("context")))


def page_text(sections: DataFrame, page: str) -> DataFrame:
    """One text a page: each section's heading after as many # as its level, then its text."""
    block = F.concat(F.repeat(F.lit("#"), F.greatest(F.col("level"), F.lit(1))), F.lit(" "), F.col("heading"), F.lit("\n"), F.col("text"))
    return joined(sections.withColumnRenamed("ordinal", "rank"), page, block, "\n\n", "page_text")


def request_error(message: Column, model: Column, models: list[str], most: int = MESSAGE_CHARS) -> Column:
    """Why a chat request is refused: no message, one too long, an unknown model; null if it is accepted."""
    return (
        F.when(F.coalesce(F.length(message), F.lit(0)) < 1, "message is empty").when(F.length(message) > most, "message is too long").when(model.isNotNull() & ~model.isin(models), "unknown model")
    )


def first_source(results: DataFrame, key: str, sources: list[DataFrame], text: str = "text") -> DataFrame:
    """results with the row of the first source that knows the key, as a whole, and the text of the first that has one.

    Each source has key, row struct and text. Keys that no source knows go.
    """
    out, rows, texts = results, [], []
    for n, s in enumerate(sources):
        out = out.join(s.select(key, F.col("row").alias(f"row_{n}"), F.nullif(F.col(text), F.lit("")).alias(f"text_{n}")), key, "left")
        rows.append(F.col(f"row_{n}"))
        texts.append(F.col(f"text_{n}"))
    out = out.select(*results.columns, F.coalesce(*rows).alias("row"), F.coalesce(*texts).alias(text))
    return out.where(F.col("row").isNotNull() | F.col(text).isNotNull())


def image_candidates(questions: DataFrame, ranked_pages: DataFrame, page_images: DataFrame, query: str, most: int = 30) -> DataFrame:
    """(query, place, local_filename): images of a question's own page, then of the pages found for it by rank, each file once, most of them.

    questions: query, page; ranked_pages: query, page, rank; page_images: page, nth, local_filename.
    """
    order = questions.select(query, "page", F.lit(0).alias("rank")).unionByName(ranked_pages.select(query, "page", "rank"))
    each = order.join(page_images, "page").groupBy(query, "local_filename").agg(F.min(F.struct("rank", "page", "nth")).alias("seen"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("seen", "local_filename"))
    return each.withColumn("place", place).where(F.col("place") <= most).select(query, "place", "local_filename")


def labelled_images(picks: DataFrame, candidates: DataFrame, query: str) -> DataFrame:
    """Labels such as img3 that an answer names, mapped back to the candidate files; unknown labels go."""
    named = candidates.select(query, F.concat(F.lit("img"), F.col("place").cast("string")).alias("label"), "local_filename")
    asked = picks.select(query, F.posexplode("labels").alias("nth", "label"))
    return asked.join(named, [query, "label"]).select(query, "nth", "local_filename")
