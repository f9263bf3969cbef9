"""Which of very many rules may fire in a text, by one pass of an Aho-Corasick automaton over it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import ahocorasick
import regex

_OPEN_GROUP = regex.compile(r"\((?:\?(?P<kind>:|=|!|<=|<!|>|P?<\w+>|'\w+'))?")
_REPEAT = regex.compile(r"(?:[?*+]|\{\d*,?\d*\})[?+]?")


def _group_end(pattern: str, at: int) -> int:
    """Behind the group that opens at `at`."""
    depth = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[":
            at = _class_end(pattern, at) - 1
        else:
            depth += (c == "(") - (c == ")")
            if not depth:
                return at + 1
        at += 1
    return at


def _class_end(pattern: str, at: int) -> int:
    at += 1
    at += pattern.startswith("^", at)
    at += pattern.startswith("]", at)
    depth = 1
    while at < len(pattern) and depth:
        c = pattern[at]
        at += 1 + (c == "\\")
        depth += (c == "[") - (c == "]")
    return at


def needed(pattern: str) -> list[str] | None:
    """Strings of which every text that the pattern matches holds one, the longest that are plainly there; None where the pattern names none.

    Only what stands outside of groups and classes counts, without characters that may be left out. Patterns with flags of their own name none.
    """
    longest, run, at = [""], "", 0

    def stop() -> None:
        nonlocal run
        longest[-1], run = max(longest[-1], run, key=len), ""

    while at < len(pattern):
        c = pattern[at]
        plain = ""
        if c == "|":
            stop()
            longest.append("")
            at += 1
            continue
        if c == "(":
            opened = _OPEN_GROUP.match(pattern, at)
            if pattern.startswith("(?", at) and not opened["kind"]:
                return None
            at = _group_end(pattern, at)
        elif c == "[":
            at = _class_end(pattern, at)
        elif c == "\\":
            follows = pattern[at + 1:at + 2]
            if follows in "QE":
                return None
            at += 2
            if not follows.isalnum():
                plain = follows
            elif follows in "pPxNkgu" and pattern.startswith("{", at):
                at = pattern.index("}", at) + 1
            elif follows in "xcu0pP":
                return None
        else:
            at += 1
            plain = "" if c in ".^$" else c
        repeat = _REPEAT.match(pattern, at)
        if not plain:
            stop()
        elif not repeat:
            run += plain
        elif repeat[0][0] == "+":
            run += plain
            stop()
        else:
            stop()
        at = repeat.end() if repeat else at
    stop()
    return longest if all(longest) else None


class Finder:
    """Literal phrases that stand in a text on their own, and patterns that it may match."""

    def __init__(self, literals: Iterable[tuple[int, str]], patterns: Iterable[tuple[int, str]]):
        """literals and patterns: (number, phrase or pattern)."""
        words: dict[str, tuple[list[int], list[int]]] = {}
        for number, phrase in literals:
            words.setdefault(phrase, ([], []))[0].append(number)
        self.always = []
        for number, pattern in patterns:
            held = needed(pattern)
            if held is None:
                self.always.append(number)
            for word in set(held or []):
                words.setdefault(word, ([], []))[1].append(number)
        self.words = ahocorasick.Automaton()
        self.numbers = list(words.values())
        for k, word in enumerate(words):
            self.words.add_word(word, (k, len(word)))
        self.words.make_automaton()

    def in_texts(self, texts: Sequence[str]) -> tuple[set[int], set[int]]:
        """(literals that stand in one of the texts, patterns to be tried)."""
        sure: set[int] = set()
        maybe = set(self.always)
        settled: set[int] = set()  # words that need no further look
        for text in texts if len(self.words) else ():
            for last, (k, size) in self.words.iter(text):
                if k in settled:
                    continue
                exact, hinted = self.numbers[k]
                maybe.update(hinted)
                if exact and not _alone(text, last - size, last + 1):
                    continue
                sure.update(exact)
                settled.add(k)
        return sure, maybe


def _alone(text: str, before: int, after: int) -> bool:
    """No letter or digit on either side."""
    return not (before >= 0 and _wordlike(text[before])) and not (after < len(text) and _wordlike(text[after]))


def _wordlike(c: str) -> bool:
    return c.isalpha() or c.isdecimal()
