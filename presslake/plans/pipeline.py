"""The whole job: subscriptions, feed documents, marks and pages -> articles, nested output, next marks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.functions.binding import let, with_computed
from presslake.functions.dates import is_newer_than_last_id
from presslake.functions.text import blank_to_null, strip_html_tags
from presslake.functions.urls import absolute_url
from presslake.operators import blacklist as bl
from presslake.operators import incremental, results
from presslake.operators.extraction import Strategy, extract_articles, usable_description
from presslake.schemas import FEED_NOT_FETCHED
from presslake.sources import feeds as feed_source
from presslake.sources.pages import candidate_pages, latest_pages, page_join


@dataclass(frozen=True)
class RunOutput:
    """Tables of one run; all lazy. extracted holds the candidates that could be among a feed's first k successes."""

    results: DataFrame
    extracted: DataFrame
    articles: DataFrame
    nested: DataFrame
    history: DataFrame
    blacklist: DataFrame


def entries_until_stale(entries: Column, last_id: Column) -> Column:
    """Datable entries of one document before its first one that is not newer than the feed's mark.

    The in-row form of take_until_stale: a document is one row, so stopping needs no join of entries and no shuffle.
    """

    def usable(e: Column) -> Column:
        return blank_to_null(e["link"]).isNotNull() & blank_to_null(e["published"]).isNotNull()

    def cut(dated: Column) -> Column:
        stale = F.transform(dated, lambda e: ~is_newer_than_last_id(e["published"], last_id))
        return let(
            F.array_position(stale, True).cast("int"),
            lambda stop: F.when(stop > 0, F.slice(dated, 1, stop - 1)).otherwise(dated),
        )

    return let(F.filter(entries, usable), cut)


def entries_until_certain(entries: Column, k: int) -> Column:
    """Entries of one document up to the k-th that is certain to succeed: its description alone would do.

    No later entry can be among the first k successes, so its page need not be joined, fetched or read.
    """

    def certain(e: Column) -> Column:
        text = feed_source.description_coalesce(e["description"], e["summary"], e["content"])
        return let(text, lambda d: usable_description(d) & (strip_html_tags(d) != ""))

    def cut(sure: Column) -> Column:
        places = F.filter(F.transform(sure, lambda s, i: F.when(s, i + 1)), lambda i: i.isNotNull())
        return let(F.try_element_at(places, F.lit(k)), lambda stop: F.when(stop.isNull(), entries).otherwise(F.slice(entries, 1, stop)))

    return let(F.transform(entries, certain), cut)


def feed_results(feeds: DataFrame, docs: DataFrame) -> DataFrame:
    """Status of each subscribed feed, once per position in the list; a feed without a document failed."""
    fetched = docs.groupBy("feed_url").agg(F.max(F.col("doc").isNotNull()).alias("_fetched"))
    joined = feeds.join(fetched, "feed_url", "left")
    success = F.coalesce(F.col("_fetched"), F.lit(False))
    return joined.select(
        "feed_ord", "feed_url", "feed_title", "feed_type",
        success.alias("success"), F.when(~success, F.lit(FEED_NOT_FETCHED)).alias("error"),
    )


def latest_documents(docs: DataFrame) -> DataFrame:
    """One document per feed: the newest fetch where docs has fetched_at, else the greatest text; absent ones give way."""
    order = F.struct(F.col("doc").isNotNull(), *[F.col(c) for c in ("fetched_at",) if c in docs.columns], "doc")
    return docs.groupBy("feed_url").agg(F.max(order)["doc"].alias("doc"))


def new_entries(feeds: DataFrame, docs: DataFrame, history: DataFrame, k: int | None = None) -> DataFrame:
    """New entries of the subscribed feeds, links rewritten: feed_ord, feed_url, fetched and the entry fields.

    With k, only those that can be among a feed's first k successes. A feed without any has one row without pos, so that
    its status can be told from these rows too.

    Marks meet feeds at document grain, one row per feed, before any entry is exploded. A feed that is listed or
    fetched twice is read once, at its first position; nest_output gives its articles to every position.
    """
    listed = feeds.groupBy("feed_url").agg(F.min("feed_ord").alias("feed_ord"))
    subscribed = latest_documents(docs).join(listed, "feed_url")
    marked = incremental.history_lookup(subscribed, history)
    parsed = feed_source.parse_documents(marked).withColumnRenamed("success", "fetched")
    fresh = with_computed(parsed, "fresh", entries_until_stale(F.col("entries"), F.col("last_id")))
    if k is not None:
        fresh = with_computed(fresh, "fresh", entries_until_certain(F.col("fresh"), k))
    entries = fresh.select("feed_ord", "feed_url", "fetched", F.inline_outer("fresh"))
    relative = ~F.col("link").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    resolved = F.when(relative, absolute_url(F.col("feed_url"), F.when(relative, F.col("link")))).otherwise(F.col("link"))
    return feed_source.rewrite_entry_links(entries.withColumn("link", resolved))


def new_candidates(feeds: DataFrame, docs: DataFrame, history: DataFrame, k: int | None = None) -> DataFrame:
    """The new entries alone: feed_ord, feed_url and the entry fields."""
    return _candidates(new_entries(feeds, docs, history, k))


def _candidates(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("fetched") & F.col("pos").isNotNull()).drop("fetched")


def extract_candidates(
    candidates: DataFrame,
    pages: DataFrame,
    blacklist: DataFrame,
    strategies: list[Strategy] | None = None,
    block_within_run: bool = False,
    reduce_pages: bool = False,
) -> DataFrame:
    """Candidates -> settled extractions, one row each.

    reduce_pages lets only pages that candidates ask for move (see candidate_pages) and reads each of them once, however many
    candidates share it. With block_within_run outcomes are joined without HTML, which then only moves for the rows that are
    still to be read.
    """
    described = candidates.withColumn(
        "description", feed_source.description_coalesce(F.col("description"), F.col("summary"), F.col("content"))
    ).drop("summary", "content")
    listed = bl.with_blocked(described, blacklist)
    if not block_within_run and reduce_pages:
        return extract_articles(listed, strategies, pages=candidate_pages(pages, listed))
    if not block_within_run:
        return extract_articles(page_join(listed, pages, reduce=reduce_pages), strategies)
    outcomes = pages.withColumn("html", F.lit(None).cast("string"))
    judged = bl.with_run_blocked(page_join(listed, outcomes, reduce=reduce_pages).drop("html"))
    wanted = judged.withColumn("_fetch", F.when(~F.col("blocked") & F.col("error_kind").isNull(), F.col("link")))
    read = page_join(wanted.withColumnRenamed("error_kind", "_kind"), pages, "_fetch", reduce=reduce_pages)
    return extract_articles(read.drop("error_kind", "_fetch").withColumnRenamed("_kind", "error_kind"), strategies)


def accepted_articles(extracted: DataFrame, k: int = incremental.MAX_ARTICLES) -> DataFrame:
    """First k successes per feed in output form, with pos for ordering and _id for the next marks."""
    return incremental.limit_successes(extracted, k).select(
        "feed_url", "pos", "title", F.col("link").alias("url"), "published", "author", "content", "images",
        F.col("published").alias("_id"), F.lit("published").alias("_id_type"),
    )


def inspected(extracted: DataFrame, articles: DataFrame, k: int = incremental.MAX_ARTICLES) -> DataFrame:
    """The rows a run gets to: those up to a feed's k-th success."""
    last = articles.groupBy("feed_url").agg(F.max("pos").alias("_last"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
    joined = extracted.join(last.select("feed_url", "_last"), "feed_url", "left")
    return joined.where(F.col("_last").isNull() | (F.col("pos") <= F.col("_last"))).drop("_last")


def failures_of(extracted: DataFrame, at: Column) -> DataFrame:
    """Network failures of a run as blacklist events (schemas.FAILURES); at is the time of the run.

    pos tells the events of one run apart: the feed's position, then the entry's.
    """
    hit = (F.col("error_kind") == "network") & ~F.col("blocked")
    pos = F.shiftleft(F.col("feed_ord"), 24) + F.col("pos")
    return extracted.where(hit).select(
        F.col("link").alias("url_or_domain"), F.col("failure_reason").alias("reason"), at.cast("timestamp_ntz").alias("ts"), pos.alias("pos")
    )


def run(
    feeds: DataFrame,
    docs: DataFrame,
    history: DataFrame,
    pages: DataFrame,
    blacklist: DataFrame,
    k: int = incremental.MAX_ARTICLES,
    strategies: list[Strategy] | None = None,
    block_within_run: bool = False,
    materialize: Callable[[DataFrame], DataFrame] | None = None,
    at: Column | None = None,
    keep_settled: bool = True,
) -> RunOutput:
    """One batch run. materialize (e.g. landed) is applied to the new entries, whose URLs pick the pages to move and which
    tell the feeds' status, and with keep_settled to the settled rows, which several outputs read; each page is then read once.

    pages may hold several fetches of a URL if it has fetched_at, else one row per URL. at is the time of the run, by
    default that of the query. The permanent domains are always blocked, and the next blacklist holds them, what was
    listed before and the domains that failed in this run.
    """
    at = F.current_timestamp() if at is None else at
    if "fetched_at" in pages.columns:
        pages = latest_pages(pages)
    seed = bl.union_seed(blacklist, bl.permanent_domains(feeds.sparkSession))
    entries = new_entries(feeds, docs, history, k)
    if materialize is not None:
        entries = materialize(entries)
        # The documents are not made and read again for the status alone.
        docs = entries.select("feed_url", F.when(F.col("fetched"), F.lit("")).alias("doc"))
    status = feed_results(feeds, docs)
    candidates = _candidates(entries)
    extracted = extract_candidates(candidates, pages, seed, strategies, block_within_run, reduce_pages=materialize is not None)
    if materialize is not None and keep_settled:
        extracted = materialize(extracted)
    articles = accepted_articles(extracted, k)
    return RunOutput(
        results=status,
        extracted=extracted,
        articles=articles,
        nested=results.nest_output(status, articles),
        history=incremental.history_update(history, articles),
        blacklist=bl.blacklist_build(failures_of(inspected(extracted, articles, k), at), seed),
    )
