"""Byte-level BPE encoding with the tokenizers library, each distinct chunk of text encoded once."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa

from quayside.llm.chunks import ChunkTable, cut, sums, text_bytes

_PLAIN = re.compile(r"[ \n]?[^\s]{1,255}")


def _places(values) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(values)] = True
    return table


# ASCII but white space and controls; first bytes of letters' blocks without any white space (those of U+0085, U+00A0, U+1680, U+2000-205F and U+3000 are left out)
_ASCII = _places(range(0x21, 0x7F))
_LEAD2, _LEAD3, _LEAD4, _TAIL = _places(range(0xC3, 0xE0)), _places(range(0xE4, 0xF0)), _places(range(0xF0, 0xF5)), _places(range(0x80, 0xC0))
_SOLID_NEXT = _ASCII | _LEAD2 | _LEAD3 | _LEAD4
_LETTER = _places([*range(65, 91), *range(97, 123)])
_STOP = _places(b".,;:!?")


class ByteBpe:
    """``encode(texts)`` gives the library's ids of each whole text, without added special tokens.

    The split pattern of byte-level BPE always ends a token before a space or newline between characters that
    aren't white space, and between an ASCII letter and a stop. The chunks between such places are encoded
    apart, each distinct one once. If the file's tokenizer is of another kind, texts are encoded whole.
    """

    def __init__(self, path: str, threads: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads else "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        newline = self.library.encode("\n", add_special_tokens=False).ids
        kind = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.by_chunk = kind and len(newline) == 1 and not any(re.search(r"[\s.,;:!?]", x) for x in self.special)
        self.newline = newline[0] if newline else -1
        self.table = ChunkTable(self._compute)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _compute(self, chunks: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(chunks)
        lines, places, broken, alone = [], [], [], []  # lines have no white space but for a leading space; many are encoded at a time
        plain = _PLAIN.fullmatch
        joined = b"\t".join(chunks)
        special = [x for x in self.special if x.encode() in joined]
        texts = joined.decode().split("\t")
        if len(texts) != len(chunks):
            texts = [c.decode() for c in chunks]
        for k, text in enumerate(texts):
            if not plain(text) or (special and any(map(text.__contains__, special))):
                alone.append((k, text))
            elif text[0] == "\n":
                lines.append(text[1:])
                broken.append(k)
                places.append(k)
            else:
                lines.append(text)
                places.append(k)
        per = 512
        for i, one in enumerate(self._ids(["\n".join(lines[i : i + per]) for i in range(0, len(lines), per)])):
            arr = np.array(one, dtype=np.int32)
            cuts = np.flatnonzero(arr == self.newline)
            group = places[i * per : (i + 1) * per]
            if len(cuts) != len(group) - 1:
                raise ValueError("a newline between chunks was not a token of its own")
            at = 0
            for k, to in zip(group, [*cuts.tolist(), len(arr)], strict=True):
                out[k] = arr[at:to]
                at = to + 1
        for k in broken:
            out[k] = np.concatenate([[self.newline], out[k]])
        for (k, _), one in zip(alone, self._ids([t for _, t in alone]), strict=True):
            out[k] = np.array(one, dtype=np.int32)
        return out

    @staticmethod
    def boundaries(buf: np.ndarray) -> np.ndarray:
        """Where the library always begins a token, whatever stands around."""
        out = np.zeros(len(buf), dtype=bool)
        at = np.flatnonzero((buf == 0x20) | (buf == 0x0A))
        at = at[(at >= 4) & (at + 1 < len(buf))]
        before = buf[at - 1]
        solid = _ASCII[before] | (_TAIL[before] & (_LEAD2[buf[at - 2]] | (_LEAD3[buf[at - 3]] & _TAIL[buf[at - 2]]) | (_LEAD4[buf[at - 4]] & _TAIL[buf[at - 2]] & _TAIL[buf[at - 3]])))
        out[at[solid & _SOLID_NEXT[buf[at + 1]]]] = True
        stops = np.flatnonzero(_STOP[buf])
        stops = stops[stops > 0]
        out[stops[_LETTER[buf[stops - 1]]]] = True
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end (int32), and the number of ids of each text. Null is the empty text."""
        if not self.by_chunk:
            got = self._ids([t or "" for t in texts.to_pylist()])
            return np.array([i for x in got for i in x], dtype=np.int32), np.array([len(x) for x in got], dtype=np.int64)
        buf, edges = text_bytes(texts)
        starts, lengths, firsts = cut(self.boundaries(buf), edges)
        entries = self.table.look_up(buf, starts, lengths)
        return self.table.gather(entries), sums(self.table.lengths[entries], firsts)


@functools.lru_cache(maxsize=1)
def shared(path: str) -> ByteBpe:
    """One encoder for each Python worker, which keeps its table from task to task."""
    return ByteBpe(path)
