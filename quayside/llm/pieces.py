"""A SentencePiece model file: its pieces, and where its encoder never joins what stands left and right."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class PieceModel:
    """What encoding needs of the model's protobuf."""

    pieces: list[tuple[str, float, int]]
    bpe: bool
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    strip_spaces: bool
    unk_id: int

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        return cls(
            [(p.piece, p.score, p.type) for p in m.pieces],
            m.trainer_spec.model_type == 2,
            m.trainer_spec.byte_fallback,
            m.normalizer_spec.precompiled_charsmap,
            m.normalizer_spec.add_dummy_prefix,
            m.normalizer_spec.remove_extra_whitespaces,
            next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN),
        )

    def by_chunk(self) -> bool:
        """Whether texts can be cut before spaces: the text isn't rewritten, and no piece has a space after something else."""
        words = [p for p, _, kind in self.pieces if kind == NORMAL]
        return self.bpe and not self.charsmap and self.dummy_prefix and not self.strip_spaces and not any(SPACE in p.lstrip(SPACE) for p in words) and not any(kind == USER for *_, kind in self.pieces)


class Cuts:
    """Places where no piece of the model spans left and right: before a space that follows something else, before a
    newline (if no piece holds one), and between an ASCII letter and a stop that no piece joins."""

    def __init__(self, model: PieceModel):
        words = [p for p, _, kind in model.pieces if kind == NORMAL]
        self.newline = not any("\n" in p for p in words)
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        joined = {p[i + 1] for p in words for i in range(len(p) - 1) if p[i] in letters}
        self.stop, self.letter = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
        self.stop[[ord(c) for c in ".,;:!?" if c not in joined]] = True
        self.letter[[ord(c) for c in letters]] = True

    def __call__(self, buf: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buf), dtype=bool)
        at = np.flatnonzero(buf == 0x20)
        at = at[at >= 3]
        before = buf[at - 1]
        mark = (before == 0x81) & (buf[at - 2] == 0x96) & (buf[at - 3] == 0xE2)  # a literal space mark
        out[at[(before != 0x20) & ~mark]] = True
        if self.newline:
            out |= buf == 0x0A
        stops = np.flatnonzero(self.stop[buf])
        stops = stops[stops > 0]
        out[stops[self.letter[buf[stops - 1]]]] = True
        return out
