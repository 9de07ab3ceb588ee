"""Many phrases in one pass over a text: two Aho-Corasick automata, over words and over characters.

A phrase may begin and end within a word of the text, so of a phrase of three words or more the inner words go into an
automaton whose symbols are words, and its two outer words are compared with what stands around a hit. Phrases of one
or two words go into an automaton over characters. Texts and phrases have single spaces and no others.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Hashable, Iterable
from itertools import repeat

import ahocorasick


class PhraseIndex:
    """Which keys have a phrase that a text contains. pairs: (phrase, key), phrases not empty."""

    def __init__(self, pairs: Iterable[tuple[str, Hashable]]):
        self.words: dict[str, int] = {}
        inner: dict[tuple[int, ...], dict[tuple[str, str], list]] = defaultdict(lambda: defaultdict(list))
        short: dict[str, list] = defaultdict(list)
        for phrase, key in pairs:
            first, *rest = phrase.split(" ")
            if len(rest) < 2:
                short[phrase].append(key)
            else:
                codes = tuple(self.words.setdefault(w, len(self.words) + 1) for w in rest[:-1])
                inner[codes][first, rest[-1]].append(key)
        self.inner = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if inner else None
        for codes, ends in inner.items():
            self.inner.add_word(codes, (len(codes), list(ends.items())))
        self.short = ahocorasick.Automaton() if short else None
        for phrase, keys in short.items():
            self.short.add_word(phrase, keys)
        for a in (self.inner, self.short):
            if a is not None:
                a.make_automaton()

    def find(self, text: str) -> set:
        out: set = set()
        if self.short is not None:
            for _, keys in self.short.iter(text):
                out.update(keys)
        if self.inner is not None:
            words = text.split(" ")
            for end, (n, ends) in self.inner.iter(tuple(map(self.words.get, words, repeat(0)))):
                at = end - n
                if at >= 0 and end + 1 < len(words):
                    before, after = words[at], words[end + 1]
                    for (first, last), keys in ends:
                        if after.startswith(last) and before.endswith(first):
                            out.update(keys)
        return out
