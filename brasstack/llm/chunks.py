"""Token ids of whole texts, a white-space chunk at a time.

Both tokenizers used here split at white space before they merge anything, so a text's ids are the ids of its chunks
in a row. Chunks repeat a lot: each is encoded once and kept as bytes (little-endian unsigned 32-bit ids), in a table
bounded in bytes. The results equal those of encoding the whole text (see the tests).
"""

from __future__ import annotations

import re
import sys

import numpy as np

#: Bytes of chunks and their ids that one Python worker keeps.
KEEP = 96 << 20
#: Bytes of an entry beside its key and value.
ENTRY = 110
#: A Latin word and the ASCII punctuation behind it: apart in any text, and the word's case is folded on its own.
_CORE = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Values of keys; what is missing is worked out when it is asked for. Emptied when it holds `keep` bytes."""

    def __init__(self, encode, keep: int):
        super().__init__()
        self.encode, self.keep, self.held = encode, keep, 0

    def __missing__(self, key):
        out = self.encode(key)
        size = sys.getsizeof(key) + sys.getsizeof(out) + ENTRY
        if self.held + size > self.keep:
            self.clear()
            self.held = 0
        if size <= self.keep // 64:  # a longer one hardly comes again
            self.held += size
            self[key] = out
        return out


class WordBPE:
    """Ids of the lower-casing word tokenizer, as encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.known = _Known(self._chunk, keep)

    def _word(self, word: str) -> bytes:
        """A folded Latin word, straight from the merges."""
        raw = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.tok.model.tokenize(raw)])

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if m := _CORE.fullmatch(text):
            word, marks = m[1].lower(), m[2]
            if marks:  # both parts come in other chunks too
                return self.known[word.encode()] + self.known[marks.encode()]
            return self._word(word) if word == text else self.known[word.encode()]
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids = self.known.__getitem__
        return [b"".join(map(ids, (t or "").encode("utf-8", "replace").split())) for t in texts]


_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class ByteBPE:
    """Token counts of the byte-level vocabulary, as len(encode_ordinary(text)) gives them."""

    SPLIT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")

    def __init__(self, path: str, pattern: str, keep: int = KEEP):
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(lambda c: len(enc.encode_ordinary(c)), keep)

    def counts(self, texts: list[str | None]) -> list[int]:
        n = self.known.__getitem__
        return [sum(map(n, self.SPLIT.findall(t or ""))) for t in texts]
