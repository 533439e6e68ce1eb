"""The vocabulary of a public SentencePiece model, read on the driver and shipped to the workers as bytes (a fixed file)."""

from __future__ import annotations

import re
from functools import lru_cache

import sentencepiece

#: The mark that stands for a space inside pieces.
MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: No piece has a mark behind another character, and none has a newline, so texts split here exactly.
PRE_TOKEN = re.compile(f"\n+|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Stands for a mark that the text itself holds; it is encoded by its bytes, so that it comes back as it was. No valid text has it.
LITERAL = "\ud800"


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Pieces:
    """ids: piece -> id of the ordinary pieces; ranks: piece -> place by score, best first; scores by id; raw: the bytes each
    id stands for; byte_ids: the id of each byte."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids, self.scores, self.raw, self.byte_ids = {}, [], [], {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.scores.append(sp.get_score(i))
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                self.raw.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.ids))
        self.ranks = {p: k for k, p in enumerate(sorted(self.ids, key=lambda p: -self.scores[self.ids[p]]))}

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in (MARK if char == LITERAL else char).encode()]


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    """One vocabulary a worker process."""
    return Pieces(model)


def marked(text: str) -> str:
    """The text with a leading mark and marks for spaces, as the model sees it; empty stays empty."""
    if not text:
        return ""
    if MARK in text:
        text = text.replace(MARK, LITERAL)
    return MARK + text.replace(" ", MARK)


def pre_tokens(text: str) -> list[str]:
    return PRE_TOKEN.findall(marked(text))
