"""Large rewriting dictionaries in few passes over a text.

Dictionaries are ordered lists of replacements, applied one after the other, so that a later key may match what an
earlier one has put in. What that comes to is worked out once, when the plan is made:

* ``literal_passes`` cuts an ordered list of literals into passes whose keys cannot meddle with each other: none overlaps
  another's end, and none is in text that an earlier key of the pass puts in. One alternation does a whole pass.
* ``word_map`` follows every whole-word key through the keys after it and gives one map from words to final texts.

Each pass splits a text into pieces, looks them up in a hash set and joins them, in time proportional to the text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's word characters, as ``(?U)\\b`` knows them.
WORD_RUNS = r"(?U)\w+|\W+"


def _overlap(a: str, b: str) -> bool:
    """True if an end of ``a``, not all of it, is a beginning of ``b``, not all of it."""
    return any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b))))


def literal_passes(pairs: list[tuple[str, str]]) -> list[dict[str, str]]:
    """An ordered list of (key, text put in) as passes; a pass is a map whose longest key at a place counts.

    Keys that hold white space, or whose text does not stand between blanks, have passes of their own, as what they put
    in may join its neighbours. Within a pass a key that holds an earlier one can never match and is left out.
    """
    passes: list[dict[str, str]] = []
    now: dict[str, str] = {}
    alone = lambda key, value: re.search(r"\s", key) or not (value.startswith(" ") and value.endswith(" "))
    for key, value in pairs:
        if not key:
            continue
        if alone(key, value):
            passes += [now, {key: value}]
            now = {}
            continue
        if any(_overlap(key, k) or _overlap(k, key) or key in v for k, v in now.items()):
            passes.append(now)
            now = {}
        if not any(k in key for k in now):
            now[key] = value
    return [p for p in [*passes, now] if p]


def _trie(keys: list[str]) -> str:
    """A pattern for any of the keys, the longest first, that looks at each character once."""
    root: dict = {}
    for k in keys:
        node = root
        for c in k:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [_quoted(c) + pattern(below) for c, below in sorted(node.items()) if c]
        if not branches:
            return ""
        inner = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return inner + "?" if "" in node else inner

    return pattern(root)


def _quoted(c: str) -> str:
    return f"\\x{{{ord(c):X}}}"


def _looked_up(pieces: Column, table: dict[str, str]) -> Column:
    # the set tells by a hash whether a piece is a key; only then is the map gone through
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_join(F.transform(pieces, lambda p: F.when(p.isin(list(table)), F.try_element_at(found, p)).otherwise(p)), "")


def replace_literals(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements as if made one after the other."""

    def one(c: Column, table: dict[str, str]) -> Column:
        if len(table) == 1:
            ((key, value),) = table.items()
            return F.replace(c, F.lit(key), F.lit(value))
        firsts = "".join(_quoted(f) for f in sorted({k[0] for k in table}))
        return _looked_up(F.regexp_extract_all(c, F.lit(rf"[^{firsts}]+|{_trie(list(table))}|[{firsts}]"), F.lit(0)), table)

    return reduce(one, literal_passes(pairs), text)


def word_map(pairs: list[tuple[str, str]], runs) -> dict[str, str]:
    """What each key of an ordered list of whole-word replacements becomes in the end; ``runs`` splits a text as Java does."""
    final: dict[str, str] = {}
    # from the last key on: what a key puts in can only be rewritten by keys after it
    for key, value in reversed(pairs):
        final[key] = "".join(final.get(w, w) for w in runs(value))
    return final


def word_runs(text: str) -> list[str]:
    """Runs of word characters and of others, in Python; see ``WORD_RUNS``."""
    return re.findall(r"[^\W]+|[\W]+", text) if text.isascii() else _unicode_runs(text)


def _is_word(c: str) -> bool:
    import unicodedata

    kind = unicodedata.category(c)
    return c.isalpha() or kind in ("Mn", "Me", "Mc", "Nd", "Pc", "Nl") or c in "\u200c\u200d"


def _unicode_runs(text: str) -> list[str]:
    out: list[str] = []
    before = None
    for c in text:
        word = _is_word(c)
        if word == before:
            out[-1] += c
        else:
            out.append(c)
        before = word
    return out


def replace_words(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whole-word replacements as if made one after the other; keys that are not one word have passes of their own."""
    steps: list[list[tuple[str, str]]] = [[]]
    seen: set[str] = set()
    for key, value in pairs:
        if not key or key in seen:
            continue
        if all(_is_word(c) for c in key):
            steps[-1].append((key, value))
        else:
            steps += [[(key, value)], []]
        seen.add(key)

    def one(c: Column, step: list[tuple[str, str]]) -> Column:
        key, value = step[0]
        if not all(_is_word(x) for x in key):
            literal = value.replace("\\", "\\\\").replace("$", r"\$")
            return F.regexp_replace(c, rf"(?U)\b\Q{key}\E\b", literal)
        return _looked_up(F.regexp_extract_all(c, F.lit(WORD_RUNS), F.lit(0)), word_map(step, word_runs))

    return reduce(one, [s for s in steps if s], text)
