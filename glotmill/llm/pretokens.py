"""Cutting texts into stretches that byte-level BPE encodes independently of each other."""

from __future__ import annotations

import re

import regex

#: Unicode white space as the tokeniser libraries have it (Python's own classes add U+001C to U+001F).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNSAFE = regex.compile(f"[{SPACE}] (?:[{SPACE}]|$)|\0")
ODD = regex.compile(rf"[^\p{{L}}\p{{N}}][,.]|[{SPACE}]\n")

#: The same white space a character each.
SPACES = [chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: A comma or full stop at the start or after anything but a Latin-1 letter or digit.
MARK = re.compile("[,.](?<![0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff][,.])")


def _after_space(text: str, mark: str) -> bool:
    """Whether white space stands before ``mark`` somewhere; most texts hold few kinds of it, which is quick to see."""
    return any(s in text and s + mark in text for s in SPACES)


def _unsafe(text: str) -> bool:
    return ("\0" in text or _after_space(text, " ")) and UNSAFE.search(text) is not None


def _odd(text: str) -> bool:
    return (MARK.search(text) is not None or _after_space(text, "\n")) and ODD.search(text) is not None


def compiled(pattern: str) -> regex.Pattern:
    """The pre-token pattern with white space spelled out; \\s, \\S and [^\\s...] are all it uses."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


def chunks(text: str, pattern: regex.Pattern) -> list[str]:
    """Stretches of ``text`` that pre-tokens never cross; they join to the text, and most are a word or a mark.

    A cut before a space is safe unless white space stands on both of its sides (or before it and nothing after it):
    only then do spaces form one pre-token with what stands before. A cut before a comma or full stop is safe after a
    letter or digit, one before a line feed after anything but white space. Texts that break the first rule are cut at
    every pre-token, texts that break the second before spaces only. Either way the pre-tokens are the same.
    """
    if _unsafe(text):
        return pattern.findall(text)
    marked = text.replace(" ", "\0 ")
    if not _odd(text):
        marked = marked.replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n")
    return marked.removeprefix("\0").split("\0")


class Memo(dict):
    """A bounded table of a function's results by its argument; when it is full it starts anew."""

    def __init__(self, function, bound: int, longest: int = 64):
        super().__init__()
        self.function, self.bound, self.longest = function, bound, longest

    def __missing__(self, argument: str):
        result = self.function(argument)
        if len(argument) <= self.longest:
            if len(self) >= self.bound:
                self.clear()
            self[argument] = result
        return result
