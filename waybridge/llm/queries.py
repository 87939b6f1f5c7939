"""The named queries of this subpackage and their SQL."""

from waybridge.llm import (
    classlm,
    decontaminate,
    htmltext,
    language,
    license,
    lines,
    packing,
    quality,
    repair,
    repeats,
    search,
    simhash,
    trie,
)

_MODULES = (license, classlm, htmltext, simhash, lines, quality, search, decontaminate, language, packing, trie, repair, repeats)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
