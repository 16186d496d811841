"""Article extraction: ordered strategies with a description fallback, as one pass over fetched pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.functions.binding import let, row_sql, sql_let, with_computed
from presslake.functions.dom import CONTENT_SELECTORS, page_elements, sql_best_element, sql_element_text, sql_rules
from presslake.functions.html import MIN_CONTENT_CHARS, body_text, main_text_density, main_text_paragraphs
from presslake.functions.images import collect_images
from presslake.functions.text import blank_to_null, content_valid, sql_clean_text, strip_html_tags
from presslake.sources.pages import asked_pages, page_join

FALLBACK_METHOD = "description-fallback"
FAILED_METHOD = "failed"

# How the outcome of a failed article is worded.
REASON_BLACKLISTED = "域名在黑名单中"
REASON_NETWORK = "网络错误"
REASON_EXHAUSTED = "所有提取方法失败"


@dataclass(frozen=True)
class Strategy:
    """A named extractor: html column -> text column, NULL when it finds nothing or gets NULL.

    List order is priority. build may use a Python helper: rows an earlier strategy settled reach it as NULL.
    """

    name: str
    build: Callable[[Column], Column]

    @property
    def method(self) -> str:
        return method_name(self.name)


def method_name(name: str) -> str:
    return name.lower().replace("+", "-")


def method_name_column(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("+"), F.lit("-"))


def selected_text(dom: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """Text of the first selector whose best element reaches 100 characters, NULL when none does."""
    rules = CONTENT_SELECTORS if rules is None else rules
    text_of = sql_let(sql_best_element("v.dom.elements", "r"), "best", sql_element_text("v.dom", "best"))
    texts = f"filter(transform({sql_rules(rules)}, r -> {text_of}), t -> length(t) >= {MIN_CONTENT_CHARS})"
    chosen = sql_let(f"try_element_at({texts}, 1)", "t", f"CASE WHEN t IS NOT NULL THEN {sql_clean_text('t')} END")
    return row_sql(chosen, dom=dom)


def main_text_selectors(html: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """Selector cascade with the whole body as last resort; NULL for a page that is NULL."""
    return F.coalesce(selected_text(page_elements(html), rules), F.when(html.isNotNull(), body_text(html)))


DEFAULT_STRATEGIES = [
    Strategy("Readability", main_text_density),
    Strategy("Newspaper3k", main_text_paragraphs),
    Strategy("CSS-Selectors", main_text_selectors),
]


def accepted_text(text: Column) -> Column:
    """A strategy's text if it is at least 100 characters and valid."""
    return F.when((F.length(text) >= MIN_CONTENT_CHARS) & content_valid(text), text)


def strategy_cascade(
    pages: DataFrame, html: str = "html", blocked: Column | None = None, strategies: list[Strategy] | None = None
) -> DataFrame:
    """Add extracted_text and extraction_method of the first accepting strategy (both NULL when none accepts).

    blocked rows and rows without HTML try nothing. Each strategy is its own step over the rows the earlier ones
    left open, so a later, costlier one does no work for settled rows.
    """
    strategies = DEFAULT_STRATEGIES if strategies is None else strategies
    usable = F.col(html) if blocked is None else F.when(~blocked, F.col(html))
    found = F.lit(None).cast("struct<text:string,method:string>")
    step = pages.withColumn("_open_html", usable).withColumn("_found", found)
    for strategy in strategies:
        source = F.when(F.col("_found").isNull(), F.col("_open_html"))
        step = with_computed(step, "_found", F.coalesce(F.col("_found"), _attempt(strategy, source)))
    return (
        step.withColumn("extracted_text", F.col("_found.text"))
        .withColumn("extraction_method", F.col("_found.method"))
        .drop("_open_html", "_found")
    )


def _attempt(strategy: Strategy, source: Column) -> Column:
    """STRUCT<text, method> if the strategy's text is accepted, else NULL."""

    def settle(text: Column) -> Column:
        return F.when(
            accepted_text(text).isNotNull(), F.struct(text.alias("text"), F.lit(strategy.method).alias("method"))
        )

    return let(strategy.build(source), settle)


def usable_description(description: Column) -> Column:
    """Judged on the raw text, tags included."""
    return content_valid(description)


def with_fallback(df: DataFrame, description: str = "description") -> DataFrame:
    """Settle rows no strategy accepted: description if usable, else failed. Adds success and content.

    Expects extracted_text and extraction_method. Content taken from a description is stripped of tags afterwards,
    so it may end up shorter than the test required.
    """
    took = F.col("extracted_text").isNotNull()
    usable = usable_description(F.col(description))
    method = (
        F.when(took, F.col("extraction_method")).when(usable, F.lit(FALLBACK_METHOD)).otherwise(F.lit(FAILED_METHOD))
    )
    raw = F.when(took, F.col("extracted_text")).when(usable, F.col(description)).otherwise(F.lit(""))

    def settle(s: Column) -> Column:
        return F.struct(
            s["method"].alias("method"),
            (s["method"] != FAILED_METHOD).alias("success"),
            content_by_method(s["raw"], s["method"]).alias("content"),
        )

    settled = let(F.struct(method.alias("method"), raw.alias("raw")), settle)
    return (
        with_computed(df, "_settled", settled)
        .withColumn("extraction_method", F.col("_settled.method"))
        .withColumn("success", F.col("_settled.success"))
        .withColumn("content", F.col("_settled.content"))
        .drop("_settled", "extracted_text")
    )


def content_by_method(content: Column, method: Column) -> Column:
    """Tags are stripped only from description text."""
    return F.when(method == FALLBACK_METHOD, strip_html_tags(content)).otherwise(content)


def failure_reason(blocked: Column, error_kind: Column, method: Column) -> Column:
    """Why an article was not extracted from its page, NULL when it was."""
    return F.when(
        method.isin(FALLBACK_METHOD, FAILED_METHOD),
        F.when(blocked, F.lit(REASON_BLACKLISTED))
        .when(error_kind == "network", F.lit(REASON_NETWORK))
        .otherwise(F.lit(REASON_EXHAUSTED)),
    )


def _read(pages: DataFrame, url: str, html: str, blocked: Column | None, strategies: list[Strategy] | None, with_images: bool) -> DataFrame:
    """Add extracted_text, extraction_method and images; images are read only from pages a strategy succeeded on."""
    step = strategy_cascade(pages, html, blocked=blocked, strategies=strategies)
    if not with_images:
        return step.withColumn("images", F.array().cast("array<string>"))
    step = step.withColumn("_page", F.when(F.col("extracted_text").isNotNull(), F.col(html)))
    return collect_images(step, url, "_page").drop("_page")


def extract_articles(
    candidates: DataFrame, strategies: list[Strategy] | None = None, with_images: bool = True, pages: DataFrame | None = None
) -> DataFrame:
    """Candidates joined with their pages -> settled articles.

    Expects link, title, author, description, html, error_kind and blocked. With pages (url, html, error_kind, one row per
    URL) candidates come without html and error_kind: then a page is read once, not once for each article that links to it,
    and the join moves texts, not HTML. That reads the candidates' URLs once more.
    """
    if pages is None:
        # A failed fetch leaves no HTML to try, whatever its kind.
        unfetched = F.coalesce(F.col("blocked") | F.col("error_kind").isNotNull(), F.lit(False))
        step = _read(candidates, "link", "html", unfetched, strategies, with_images).drop("html")
    else:
        read = _read(asked_pages(pages, candidates), "url", "html", None, strategies, with_images).drop("html")
        # An exchange of its own: a URL that very many articles share is then split in the join, after the reading.
        step = page_join(candidates, read.repartition("url"), values=("extracted_text", "extraction_method", "images"))
        blocked = F.coalesce(F.col("blocked"), F.lit(False))
        for name in ("extracted_text", "extraction_method"):
            step = step.withColumn(name, F.when(~blocked, F.col(name)))
        step = step.withColumn("images", F.coalesce(F.when(~blocked, F.col("images")), F.array().cast("array<string>")))
    step = with_fallback(step)
    return (
        step.withColumn(
            "failure_reason", failure_reason(F.col("blocked"), F.col("error_kind"), F.col("extraction_method"))
        )
        .withColumn("title", F.coalesce(blank_to_null(F.col("title")), F.lit("Unknown")))
        .withColumn("author", F.coalesce(blank_to_null(F.col("author")), F.lit("Unknown")))
    )
