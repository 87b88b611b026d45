"""Token ids of whole texts by the tokenizers library."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa

from panoquery.llm.common import trim

END = 0
ID_TYPE = np.dtype("<u4")
KNOWN = 400_000
# Byte-level BPE splits a text into contractions, runs of letters, of digits and of other signs (each with a space before),
# and spaces. For texts of these characters the classes are plain ranges; other texts are encoded whole, so that libraries
# can't differ in character classes.
PLAIN = re.compile("[\t-\r -~¡-ɏ]*")
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
PIECES = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
# The sign that stands for each byte inside a byte-level model: itself where it is printable, else the next one from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = dict(zip(_PRINTABLE, _PRINTABLE, strict=True)) | {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_PRINTABLE)))}
SPACE = chr(BYTE_SIGNS[ord(" ")])


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces(dict):
    """The ids of each piece as bytes, encoded by the tokenizer's model when first asked for. Holds at most ``most`` pieces."""

    def __init__(self, tokenizer, most: int):
        self.tokenize, self.most = tokenizer.model.tokenize, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if piece.isascii() and piece[-1] > " ":  # no white space but a space before
            signs = SPACE + piece[1:] if piece[0] == " " else piece
        else:
            signs = piece.encode().decode("latin-1").translate(BYTE_SIGNS)
        ids = [t.id for t in self.tokenize(signs)]
        raw = self[piece] = pack(f"<{len(ids)}I", *ids)
        return raw


class Encoder:
    """Encodes texts by the tokenizer file at ``path``, as its ``encode`` does without adding special tokens.

    Texts that hold the string of an added token are encoded whole by the library, which makes that token's id of it. A byte-level BPE tokenizer splits a text into pieces by ``PIECES`` and encodes each by itself, so distinct pieces are
    encoded once and kept in a table of at most ``KNOWN`` pieces (200 bytes each).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.model._resize_cache(0)  # the table below does its work
        self.known = Pieces(self.tokenizer, KNOWN)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        end, ids_of = np.array([END], ID_TYPE).tobytes(), self.known.__getitem__
        out = []
        for text in texts:
            if not text or (PLAIN.fullmatch(text) and not any(x in text for x in self.added)):
                out.append(np.frombuffer(b"".join(map(ids_of, PIECES.findall(text or ""))) + end, ID_TYPE))
            else:
                out.append(np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END], ID_TYPE))
        return out


_ENCODERS: dict[str, Encoder] = {}  # a worker that is used again keeps what it has learned


def encoded(batches: Iterator[pa.RecordBatch], path: str, known: int = KNOWN, rows: int = 256) -> Iterator[tuple[list, list[np.ndarray]]]:
    """doc_ids and id arrays of a few documents at a time, from batches with doc_id and text."""
    encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
    encoder.known.most = known
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())
    trim()
