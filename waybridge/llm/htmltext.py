"""Main text of web pages by the maximum-scoring run of tokens.

A page is a line of tokens, words and tags.  Plain words score positive and tags negative, with
weights learned from pages that mark their article themselves; one linear scan finds
the contiguous run with the greatest sum.  What stands inside the run but in a menu, a
form, an advert or the like has weights of its own and is left out of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybridge.llm.common import read, texts, type_of

#: element names with a weight each; all others share one
TAGS = frozenset(
    (
        "a abbr address article aside audio b base blockquote body br button caption center cite code col dd del "
        "details dialog div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head "
        "header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta nav noscript "
        "object ol option p picture pre q s samp script section select small source span strike strong style sub "
        "summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"
    ).split()
)
#: elements that stand inside a line of text
INLINE = frozenset(
    (
        "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
        "strike strong sub sup time tt u var wbr"
    ).split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr !doctype".split()
)
#: elements whose text is never content
ASIDE = frozenset(
    (
        "head title nav aside footer form button select option textarea dialog menu iframe object svg "
        "noscript template audio video map"
    ).split()
)
#: words in class, id or role that mark an element as no content
MARKS = frozenset(
    (
        "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
        "cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation navigational newsletter notice "
        "notices pagination popup promo promoted related replies reply respond search share sharing sidebar signup "
        "social sponsor sponsored subscribe teaser toolbar widget widgets alert contentinfo complementary"
    ).split()
)
MAIN = ("article", "main")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|textarea|template|noscript|svg|iframe)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:.-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def parse(html: str) -> list[tuple]:
    """Tokens of a page: ("t", name, in a main element) for tags, (kind, text, in main) for text.

    Kinds of text: "w" plain words, "l" words of links, "n" words of elements that are no
    content.  A text token is cut only by tags; ("b", "", in main) stands before a new block.
    """
    out: list[tuple] = []
    stack: list[tuple[str, bool]] = []
    main = aside = links = 0

    def close(name: str) -> None:
        nonlocal main, aside, links
        if not any(n == name for n, _ in stack):
            return
        while stack:
            n, noise = stack.pop()
            main -= n in MAIN
            aside -= noise
            links -= n == "a"
            if n == name:
                return

    def text(part: str) -> None:
        if part:
            kind = "n" if aside else "l" if links else "w"
            out.append((kind, part, main > 0))

    at = 0
    for m in _TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        name = (m[1] or m[3] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            out.append(("b", "", main > 0))
        # inside an article, what is no content neither scores nor breaks the run
        scores = not (aside and main)
        if m[1] or m[2]:
            if scores:
                out.append(("t", name, main > 0))
            if m[2]:
                close(name)
            continue
        if name in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or name in MAIN:
            close("p")
        if name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            close(name)
        if name == "br":
            text(" ")
        if name not in VOID and not m[4].endswith("/"):
            named = " ".join(x for g in _NAMED.findall(m[4]) for x in g if x)
            noise = (
                name in ASIDE
                or name == "header" and not main
                or name not in ("html", "body", *MAIN)
                and any(p.lower() in MARKS for p in _PART.findall(named))
            )
            stack.append((name, noise))
            main += name in MAIN
            aside += noise
            links += name == "a"
        if scores:
            out.append(("t", name, main > 0))
    # what looks like a cut-off tag at the end is markup, not text
    tail = html[at:]
    text(re.sub(r"<[!/?a-zA-Z][^>]*\Z", "", tail))
    return out


def weighed(tokens: list[tuple]) -> Iterator[tuple[str, int, bool]]:
    """(feature, number, in main) of the tokens that score."""
    for kind, value, inside in tokens:
        if kind == "t":
            yield f"<{value if value in TAGS else '?'}>", 1, inside
        elif kind != "b" and (n := len(value.split())):
            yield kind, n, inside


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weight of each feature from the pages that hold exactly one article or main element.

    The weight is the log odds that a token of this kind stands inside it; for a plain word
    at least 0.1, for a tag at most -0.1.  All pages are counted, in Spark; the table has one row per
    feature.  Without labelled pages words weigh 1, block tags -1 and tags in a line -0.1.
    """

    def work(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        held: Counter = Counter()
        for batch in batches:
            for html in batch.column("text").to_pylist():
                tokens = parse(html)
                if sum(1 for m in re.finditer(r"<(?:article|main)\b", html, re.I)) == 1:
                    for feature, n, inside in weighed(tokens):
                        held[feature, inside] += n
        rows = list(held.items())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k, _ in rows], pa.string()),
                pa.array([k[1] for k, _ in rows], pa.bool_()),
                pa.array([n for _, n in rows], pa.int64()),
            ],
            ["feature", "inside", "n"],
        )

    source = texts(pages, html_col, html_col).select("text")
    counts: dict[tuple[str, bool], int] = {}
    table = source.mapInArrow(work, "feature string, inside boolean, n long")
    for r in table.groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect():
        counts[r["feature"], r["inside"]] = r["n"]
    import math

    out = {}
    for feature in {f for f, _ in counts}:
        odds = math.log((counts.get((feature, True), 0) + 1) / (counts.get((feature, False), 0) + 1))
        out[feature] = max(0.1, odds) if feature == "w" else min(-0.1, odds)
    return {"w": 1.0} | out


def score_of(token: tuple, weights: dict[str, float]) -> float:
    """Score of a token; features that were not learned weigh little inside a line, else -1."""
    kind, value, inside = token
    if kind == "t":
        rare = -0.1 if value in INLINE else -1.0
        return weights.get(f"<{value if value in TAGS else '?'}>", rare)
    if kind == "b" or kind == "n" and inside:
        return 0.0
    return len(value.split()) * weights.get(kind, -0.1 if kind == "l" else -1.0)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the run with the greatest sum; the first, longest one on ties."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def main_text(html: str, weights: dict[str, float]) -> str:
    import html as entities

    tokens = parse(html)
    start, end = best_run([score_of(t, weights) for t in tokens])
    blocks, current = [], []
    for kind, value, _ in tokens[start:end]:
        if kind == "b":
            blocks.append("".join(current))
            current = []
        elif kind in "wl":
            current.append(value)
    blocks.append("".join(current))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def extract_main(
    pages: DataFrame,
    weights: dict[str, float],
    id_col: str = "page_id",
    html_col: str = "html",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, ``keep``, text): the main text of every page, blocks joined by a blank line.

    Null and empty pages, and pages without a run of positive score, give an empty
    text.  Nothing is cut off; each row gives one row, whatever repeats.
    """
    source = texts(pages, id_col, html_col, *keep)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [main_text(h, weights) for h in batch.column("text").to_pylist()]
            rest = batch.select(["id", *keep])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, pa.string())], [*rest.schema.names, "text"])

    kinds = ", ".join(f"`{c}` {type_of(source, c)}" for c in ("id", *keep))
    return source.mapInArrow(work, f"{kinds}, text string")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    found = extract_main(pages, learn_weights(pages), keep=("url",))
    return found.select(
        F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


QUERIES = {"op3_main_text": op3_main_text}
SQL: dict[str, str] = {}
