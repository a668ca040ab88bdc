"""Token ids of whole texts with the tokenizers library, as little-endian unsigned 32-bit bytes.

Encoding a text equals joining the encodings of its chunks (a word, with the one space before it for
byte-level vocabularies), since neither vocabulary merges across a chunk's edge. Workers keep the ids of
chunks they have met, so the library only encodes new ones. Texts with other white space than single
spaces and line feeds between words are given to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

#: Latin letters, then perhaps punctuation: one word of the vocabulary's splitting rule, or two.
PLAIN_WORD = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+([!-/:-@\[-`{-~]*)")
BYTE_CHUNK = re.compile(r" ?[^ \n]+|\n")
#: Most chunks a worker remembers; beyond it the older half goes.
KEPT_CHUNKS = 1_000_000


class Encoder:
    def __init__(self, path: str, kind: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = kind
        self.known: dict[str, bytes] = {}
        names = self.library.get_vocab(with_added_tokens=True)
        #: Marks the ids that begin a chunk with a space (byte), or that end a word (word).
        self.edge = np.zeros(max(names.values()) + 1, bool)
        self.edge[[i for x, i in names.items() if (x.startswith("\u0120") if kind == "byte" else x.endswith("</w>"))]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode chunks. Most go to the library in one text, whose ids are cut where a chunk begins or ends."""
        if self.kind == "byte":
            joint, rest, sizes = [c for c in new if c[0] == " " and "<|" not in c], [c for c in new if c[0] != " " or "<|" in c], None
        else:
            joint, sizes, rest = [], [], []
            for c in new:
                m = PLAIN_WORD.fullmatch(c)
                if m:
                    joint.append(c)
                    sizes.append(2 if m[1] else 1)
                else:
                    rest.append(c)
        if joint:
            data = self._library([("" if self.kind == "byte" else " ").join(joint)])[0]
            at = np.flatnonzero(self.edge[np.frombuffer(data, "<u4")])
            if sizes is None:
                begin = at
                end = np.append(at[1:], len(data) // 4)
            else:
                last = np.cumsum(sizes) - 1
                end = at[last] + 1 if len(at) == last[-1] + 1 else at[:0]
                begin = np.append(0, end[:-1])
            if len(begin) == len(joint) == len(end):
                self.known.update(zip(joint, [data[a:b] for a, b in zip((4 * begin).tolist(), (4 * end).tolist())]))
            else:
                rest += joint
        if rest:
            self.known.update(zip(rest, self._library(rest)))

    def _chunks(self, text: str) -> list[str] | None:
        """The chunks of a text; None if its words are not parted by single spaces and line feeds."""
        words = text.split()
        gaps = len(words) - 1
        if sum(map(len, words)) + gaps != len(text) or text.count(" ") + text.count("\n") != gaps:
            return None
        return words if self.kind == "word" else BYTE_CHUNK.findall(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null and empty texts have none."""
        parts: list[list[str] | None] = []
        for text in texts:
            parts.append(self._chunks(text) if text else [])
        if len(self.known) > KEPT_CHUNKS:
            old = list(self.known)
            for chunk in old[: len(old) // 2]:
                del self.known[chunk]
        new = list(set().union(*(p for p in parts if p is not None)).difference(self.known))
        for i in range(0, len(new), 5000):
            self._learn(new[i : i + 5000])
        get = self.known.__getitem__
        return [self._library([t])[0] if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts, strict=True)]


@functools.lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> Encoder:
    return Encoder(path, kind)


def text_groups(texts: list[str | None], limit: int = 1 << 21):
    """Ranges of rows of about ``limit`` characters; a longer text makes a range of its own."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)
