"""Retrieval and page tools as plain callables with a name, a description and the names and types of their arguments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import html as H
from lodeweave.functions import text as T
from lodeweave.operators import retrieval


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    arguments: dict[str, type]
    call: Callable[..., DataFrame] = field(repr=False)

    def __call__(self, **given: object) -> DataFrame:
        if set(given) != set(self.arguments):
            raise ValueError(f"{self.name} takes {sorted(self.arguments)}")
        for name, kind in self.arguments.items():
            if not isinstance(given[name], kind):
                raise ValueError(f"{name} must be {kind.__name__}")
        return self.call(**given)


def knowledge_tool(store: DataFrame, embed: Callable[[str], list[float]]) -> Tool:
    """Answers a question from a store; embed turns the question into a vector as the store's texts were."""

    def ask(query: str) -> DataFrame:
        hits = retrieval.across_collections(store, embed(query))
        names = [r.collection for r in store.select("collection").distinct().orderBy("collection").collect()]  # collections are few
        return retrieval.answer(hits, query, names)

    return Tool("knowledge_search", "Looks a question up in the stored collections.", {"query": str}, ask)


def page_tool(fetch: Callable[[str], DataFrame]) -> Tool:
    """The readable text of one page; fetch gives a row with html, such as sources.files.fetched."""

    def show(url: str) -> DataFrame:
        return fetch(url).select("url", T.page_text(H.visible_text_udf("html")).alias("text"), F.col("error_message"))

    return Tool("page_text", "Fetches a page and shows its text.", {"url": str}, show)
