"""Pages reduced to their news: the element that holds the article, its paragraphs, and the sentences that say most within a budget."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ripplegraph.plans.catalog import query
from ripplegraph.session import table

# Fixed values that results depend on.
ROOT_CHARS, PARAGRAPH_CHARS, BODY_CHARS, SENTENCE_CHARS = 200, 40, 200, 20
MOST_SENTENCES, MOST_CHARS, LEDE = 8, 1200, 2
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg", "button", "iframe", "figure")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements whose start ends an open paragraph.
BLOCKS = ("address", "article", "blockquote", "div", "dl", "fieldset", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "main", "ol", "p", "pre", "section", "table", "ul")

# Our own lists, replaceable by parameters. A stem is the beginning of a word.
EVENT_STEMS = ("acqui", "merge", "takeover", "recall", "lawsuit", "sanction", "tariff", "approv", "bankrupt", "layoff", "strike", "shortage", "halt", "delay", "launch", "profit", "loss", "dividend", "resign", "appoint", "breach", "guidance")
UNITS = ("%", "percent", "million", "billion", "trillion")
#: Requests to a reader that is a model: a verb followed within four words by an object, and phrases.
BAIT_VERBS, BAIT_OBJECTS = ("ignore", "disregard", "forget"), ("instructions", "prompt", "rules", "above")
BAIT_PHRASES = ("system prompt", "you are now", "new instructions", "assistant:")


class _Tree(HTMLParser):
    """Elements as [name, parent, items]; an item is a text or an element. Dropped elements are read but not kept, at any depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ["", None, []]
        self.at, self.all = self.root, []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self._close("p")
        node = [tag, self.at, []]
        if tag not in VOID:
            if tag not in DROPPED:
                self.at[2].append(node)
                self.all.append(node)
            self.at = node
        else:
            self.at[2].append(" ")

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(tag)

    def _close(self, tag: str) -> None:
        node = self.at
        while node is not None and node[0] != tag:
            # A paragraph isn't closed by what begins inside a block that it holds.
            if tag == "p" and node[0] in BLOCKS + DROPPED:
                return
            node = node[1]
        if node is not None and node[1] is not None:
            self.at = node[1]

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        self.at[2].append(data)


def _text(node: list) -> str:
    """The words below an element, single spaces between texts; a walk with its own stack, so depth is no matter."""
    out, todo = [], [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        else:
            todo.extend(reversed(item[2]))
    kept = "".join(c if c in "\t\n\r" or ord(c) >= 32 else " " for c in " ".join(out))
    return " ".join(kept.split())


def article_body(html: str) -> str | None:
    """The text of the page's article, or None where there is none to speak of.

    The first `article`, else the first `main`, of more than ROOT_CHARS; else the div or section whose own paragraphs hold most text (the
    first of equals); else the whole page. Its paragraphs of more than PARAGRAPH_CHARS, or all its text where there is none.
    """
    tree = _Tree()
    tree.feed(html)
    tree.close()
    root = None
    for name in ("article", "main"):
        first = next((n for n in tree.all if n[0] == name), None)
        if root is None and first is not None and len(_text(first)) > ROOT_CHARS:
            root = first
    if root is None:
        root, most = tree.root, 0
        for n in tree.all:
            if n[0] in ("div", "section"):
                held = sum(len(_text(c)) for c in n[2] if not isinstance(c, str) and c[0] == "p")
                if held > most:
                    root, most = n, held
    paragraphs, todo = [], [root]
    while todo:
        node = todo.pop()
        if node[0] == "p":
            paragraphs.append(_text(node))
        todo.extend(c for c in reversed(node[2]) if not isinstance(c, str))
    body = " ".join(t for t in paragraphs if len(t) > PARAGRAPH_CHARS) or _text(root)
    return body if len(body) >= BODY_CHARS else None


@F.pandas_udf(StringType())
def page_body(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else article_body(h))


def _any(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def key_sentences(body: Column, names: Column | None = None, stems: tuple[str, ...] = EVENT_STEMS, most: int = MOST_SENTENCES, chars: int = MOST_CHARS) -> Column:
    """The sentences of a text that say most, in their order: the lede, then those with a name and a figure, a name, a figure and an event, an event.

    Sentences without any of these go, also shorter ones than SENTENCE_CHARS. At most `most`, and as many of them from the first as
    `chars` hold. `names` is an array of lower-case names. Requests to a model become [redacted]. Array functions
    only, so a page's sentences never leave its row. Null for a null text, empty where no sentence fits.
    """
    apart = F.regexp_replace(body, r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}\"'“])", "\u0001")
    long = F.filter(F.transform(F.split(apart, "\u0001"), F.trim), lambda s: F.length(s) > SENTENCE_CHARS)
    sentences = F.when(F.size(long) > 0, long).otherwise(F.array(F.substring(body, 1, chars)))
    named = lambda s: F.lit(False) if names is None else F.coalesce(F.exists(names, lambda n: F.lower(s).contains(n) & (n != "")), F.lit(False))
    figure = lambda s: F.rlike(s, F.lit(rf"(?i)[$€£¥₩₹]\s?\d|\b\d{{2,}}\b|\b\d+(\.\d+)?\s?({_any(UNITS)})(?!\w)"))
    event = lambda s: F.rlike(s, F.lit(rf"(?i)\b({_any(stems)})"))

    def rank(s: Column, i: Column) -> Column:
        level = F.when(i < LEDE, 0).when(named(s) & figure(s), 1).when(named(s), 2).when(figure(s) & event(s), 3).when(event(s), 4)
        return F.struct(level.alias("level"), i.alias("i"), s.alias("s"))

    ranked = F.sort_array(F.filter(F.transform(sentences, rank), lambda x: x["level"].isNotNull()))
    chosen = F.sort_array(F.transform(F.slice(ranked, 1, most), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<string>").alias("out"))

    def take(acc: Column, x: Column) -> Column:
        # The total grows past the budget with the first sentence that doesn't fit, so none follows it.
        fits = acc["total"] + F.length(x["s"]) <= chars
        return F.struct((acc["total"] + F.length(x["s"]) + F.when(fits, 1).otherwise(chars + 1)).alias("total"), F.when(fits, F.concat(acc["out"], F.array(x["s"]))).otherwise(acc["out"]).alias("out"))

    text = F.aggregate(chosen, start, take, lambda acc: F.array_join(acc["out"], " "))
    bait = rf"(?i)\b({_any(BAIT_VERBS)})(\s+\w+){{0,4}}\s+({_any(BAIT_OBJECTS)})\b|" + "|".join(p.replace(" ", r"\s+").replace(":", r"\s*:") for p in BAIT_PHRASES).join(("(", ")"))
    return F.when(body.isNotNull(), F.regexp_replace(text, bait, "[redacted]"))


@query()
def reduced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, n_body (characters of the article), reduced; null where a page has no article. The name looked for is the first long word of the title."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    names = F.slice(F.filter(F.split(F.lower(title), r"\W+"), lambda w: F.length(w) > 4), 1, 1)
    rows = table(spark, sf_dir, "pages").select("page_id", names.alias("names"), page_body("html").alias("body"))
    return rows.select("page_id", F.length("body").cast("long").alias("n_body"), key_sentences(F.col("body"), F.col("names")).alias("reduced"))
