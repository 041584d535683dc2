"""Token ids of two public vocabularies: byte-level BPE of 50,257 ids, and BPE with word ends of 49,408."""

from __future__ import annotations

import base64
import json
import re
from functools import cached_property, lru_cache

import numpy as np

#: Texts of these characters, of no longer words and without added tokens have equal ids in both libraries, and one is five times as fast.
_PLAIN = re.compile(r"[\t\n\x20-\x7e¡-ɏ]*")
_LONG_WORD = re.compile(r"[^\t\n\x20]{1000}")


class ByteBpe:
    """ids(text) as the tokenizers library makes them from its file; plain texts go by the same vocabulary's ranks in tiktoken."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        self.json_path = json_path
        with open(json_path, encoding="utf-8") as vocabulary:
            added = [t["content"] for t in json.load(vocabulary)["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def any(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def ids(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and not _LONG_WORD.search(text) and not self.added.search(text):
            return np.asarray(self.plain.encode_to_numpy(text, disallowed_special=()), "<u4")
        return np.array(self.any.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(1)
def byte_bpe_50k() -> ByteBpe:
    """The vocabulary on this machine."""
    import public_tokenizers as files

    return ByteBpe(str(files.path("byte_bpe_50k.json")), str(files.path("byte_bpe_50k.tiktoken")), files.PATTERN)


class WordBpe(dict):
    """ids(text) as the tokenizers library makes them from the file of a vocabulary that drops white space.

    No id spans white space there, so a text's ids are those of its words, which are kept (as bytes) until they take
    `most` bytes. Plain words that are new go by the same vocabulary's merges in tiktoken, all of a call at once: there a
    space ends each part of a word, and a line feed is a part between two words.
    """

    _LETTERS, _NUMBERS = "a-zA-ZªµºÀ-ÖØ-öø-įı-ɏ", "0-9²³¹¼½¾"
    #: The vocabulary's own parts of a word, for plain ones.
    _PARTS = re.compile(rf"\n|'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
    _PLAIN = re.compile(r"[\n\x21-\x7e¡-įı-ɏ]*")
    _LONG_WORD = re.compile(r"[^\n]{1000}")

    def __init__(self, json_path: str, most: int = 100 << 20):
        import tiktoken

        super().__init__()
        self.json_path, self.most, self.held = json_path, most, 0
        with open(json_path, encoding="utf-8") as file:
            whole = json.load(file)
        self.added = re.compile("|".join(re.escape(t["content"]) for t in whole["added_tokens"]) or "(?!)")
        model = whole["model"]
        end, to_byte = model["end_of_word_suffix"], _bytes_of_letters()
        ranks = {}
        for token, number in model["vocab"].items():
            last = token.endswith(end)
            ranks[bytes(to_byte[c] for c in token.removesuffix(end)) + b" " * last] = number
        self.plain = tiktoken.Encoding("word_bpe_49k", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.between = ranks[b"\n "]

    @cached_property
    def any(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def _learn(self, words: list[bytes]) -> None:
        joined = b"\n".join(words).decode()
        if not self._PLAIN.fullmatch(joined) or self._LONG_WORD.search(joined) or self.added.search(joined):
            plain = []
            for word in words:
                text = word.decode()
                if self._PLAIN.fullmatch(text) and len(text) < 1000 and not self.added.search(text):
                    plain.append(word)
                else:
                    self[word] = np.array(self.any.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            words, joined = plain, b"\n".join(plain).decode()
        if words:
            ids = self.plain.encode_to_numpy(" ".join(self._PARTS.findall(joined.lower())) + " ", disallowed_special=())
            ends = (4 * np.flatnonzero(ids == self.between)).tolist()
            ids = ids.astype("<u4", copy=False).tobytes()
            for word, begin, stop in zip(words, [0, *(e + 4 for e in ends)], [*ends, len(ids)], strict=True):
                self[word] = ids[begin:stop]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.held > self.most:
            self.clear()
            self.held = 0
        words = [t.encode().split() for t in texts]
        new = list(set().union(*words).difference(self))
        if new:
            self._learn(new)
            self.held += sum(map(len, new)) * 3 + 200 * len(new)
        return [np.frombuffer(b"".join(map(self.__getitem__, w)), "<u4") for w in words]

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]


def _bytes_of_letters() -> dict[str, int]:
    """The byte that a letter stands for in files of byte-level vocabularies: itself where it can be printed, else one of
    those from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(1)
def word_bpe_49k() -> WordBpe:
    """The vocabulary on this machine."""
    import public_tokenizers as files

    return WordBpe(str(files.path("word_bpe_49k.json")))
