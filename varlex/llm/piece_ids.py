"""Token ids of whole texts by two public libraries, each asked once for every different piece of text."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

from varlex.llm.common import BoundedCache, chunked_matches, per_worker
from varlex.llm.token_counts import CUT, SPACE, Counter

LONG = 1 << 20
# Pieces sent to a library together.
JOINED = 512
# Blanks and line ends belong to the piece behind them, but for a single line end; a plain word ends at a mark.
PIECE = re.compile(r"\n(?=[^ \n])|[ \n]*[A-Za-z]+(?=[ \n.,;:!?)\"])|[ \n]*[^ \n]+|[ \n]+")
# Any other white space, by anybody's definition, may join a run of blanks over the end of a piece.
OTHER_SPACE = re.compile(r"[^\S \n]")
# Between these no pre-token reaches over, whatever surrounds them.
SAFE = re.compile(r"(?<=[A-Za-z0-9,.])(?= [A-Za-z0-9])")


def safe_blocks(text: str, size: int = 100_000) -> Iterator[str]:
    """The text in blocks of about ``size`` characters, cut where pre-tokens end in any case."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def printable_bytes() -> dict[str, int]:
    """The byte behind each character that a byte-level vocabulary writes for it.

    Printable characters of the first 256 stand for themselves; the others
    follow from 256 on in ascending order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces:
    """Ids by piece, as little-endian 32-bit integers, kept between batches."""

    def __init__(self):
        self.known = BoundedCache()

    def split(self, text: str) -> Iterator[list[str]]:
        raise NotImplementedError

    def direct(self, text: str) -> bytes | None:
        """Ids of a text that can't be cut into pieces; None where it can be."""
        return None

    def learn(self, pieces: Iterable[str]) -> None:
        raise NotImplementedError

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; pieces of texts that aren't long are learned together."""
        found = [self.direct(t) for t in texts]
        split = [
            next(self.split(t), []) if f is None and len(t) <= LONG else None for t, f in zip(texts, found)
        ]
        self.learn(chain.from_iterable(s for s in split if s))
        known = self.known.__getitem__
        for k, pieces in enumerate(split):
            if pieces is not None:
                found[k] = b"".join(map(known, pieces))
        for k, text in enumerate(texts):
            if found[k] is None:
                parts = bytearray()
                for pieces in self.split(text):
                    self.learn(pieces)
                    parts += b"".join(map(known, pieces))
                found[k] = bytes(parts)
        return found


class BytePieces(Pieces):
    """A byte-level BPE tokenizer of the tokenizers library.

    Its pre-tokens never hold a blank or a line end behind another character,
    and how they cut a run of blanks depends on that run alone.  So a text
    whose only white space is blanks and line ends may be cut in front of each
    run; other texts, and those with special strings, go to the library whole
    (very long ones in blocks cut at safe places).
    """

    def __init__(self, path: str, special: bool):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        before = rules["pre_tokenizer"] or {}
        if rules["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("pieces are proven for byte-level tokenizers that keep texts as they are")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t["content"] for t in rules["added_tokens"]] if special else []
        plain = printable_bytes()
        names = {i: t for t, i in rules["model"]["vocab"].items()}
        names |= {t["id"]: None for t in rules["added_tokens"]}
        self.added = {t["id"]: t["content"].encode() for t in rules["added_tokens"]}
        self.bytes = [
            self.added[i] if names.get(i) is None and i in self.added
            else bytes(plain[c] for c in names[i]) if i in names else b""
            for i in range(max(names) + 1)
        ]
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)
        ]

    def direct(self, text: str) -> bytes | None:
        if OTHER_SPACE.search(text) is None and not any(s in text for s in self.special):
            return None
        if len(text) <= LONG:
            return self._library([text])[0]
        return b"".join(self._library([block])[0] for block in safe_blocks(text))

    def split(self, text: str) -> Iterator[list[str]]:
        return chunked_matches(PIECE, text)

    def learn(self, pieces: Iterable[str]) -> None:
        missing = self.known.missing(pieces)
        # Behind one another they are a text that is cut in front of each piece; a line end keeps the others apart.
        inner = [p for p in missing if p[-1] not in " \n"]
        for k in range(0, len(inner), JOINED):
            some = inner[k : k + JOINED]
            apart = [p if p[0] in " \n" else "\n" + p for p in some]
            ids = np.array(self.tokenizer.encode("".join(apart), add_special_tokens=False).ids, "<u4")
            stops = 1 + np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p.encode()) for p in apart]))
            data, cuts = ids.tobytes(), (4 * stops).tolist()
            self.known.update(
                (p, data[a + 4 if p[0] not in " \n" else a : b]) for p, a, b in zip(some, [0, *cuts], cuts)
            )
        rest = [p for p in missing if p[-1] in " \n"]
        if rest:
            self.known.update(zip(rest, self._library(rest)))


class ModelPieces(Pieces):
    """A piece model of the sentencepiece library, cut where ``token_counts`` proves that no merge crosses.

    ``broken`` has the pieces whose tokens don't spell them.
    """

    def __init__(self, path: str):
        super().__init__()
        counter = Counter(path)
        self.model, self.pattern, self.line_end = counter.model, counter.pattern, counter.line_end
        self.cut_ids = self.model.encode(CUT)[1:]
        size = self.model.get_piece_size()
        self.bytes = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i)
            else b"" if self.model.is_control(i) or self.model.is_unknown(i)
            else name.replace(SPACE, " ").encode("utf-8", "surrogatepass")
            for i, name in ((i, self.model.id_to_piece(i)) for i in range(size))
        ]
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, size)
        self.broken: set[str] = set()

    def split(self, text: str) -> Iterator[list[str]]:
        return chunked_matches(self.pattern, SPACE + text.replace(" ", SPACE) if text else "")

    def spelled(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def learn(self, pieces: Iterable[str]) -> None:
        missing = list(self.known.missing(pieces))
        plain = [p for p in missing if CUT not in p] if len(self.cut_ids) == 1 else []
        for k in range(0, len(plain), JOINED):
            some = plain[k : k + JOINED]
            ids = np.array(self.model.encode(CUT + CUT.join(some).replace(SPACE, " "), num_threads=1), "<u4")
            cuts = np.flatnonzero(ids == self.cut_ids[0])
            if len(cuts) == len(some):
                data, stops = ids.tobytes(), np.append(cuts[1:], len(ids))
                self.known.update(
                    zip(some, (data[4 * a + 4 : 4 * b] for a, b in zip(cuts.tolist(), stops.tolist())))
                )
            else:
                self._one_by_one(some)
        chosen = set(plain)
        self._one_by_one([p for p in missing if p not in chosen])
        for piece in missing:
            if self.spelled(self.known[piece]) != piece.replace(SPACE, " ").encode("utf-8", "surrogatepass"):
                self.broken.add(piece)

    def _one_by_one(self, pieces: list[str]) -> None:
        if pieces:
            ids = self.model.encode([CUT + p.replace(SPACE, " ") for p in pieces], num_threads=1)
            start = 1 + self.line_end
            self.known.update(zip(pieces, (np.array(i[start:], "<u4").tobytes() for i in ids)))


def byte_pieces(path: str, special: bool) -> BytePieces:
    """Loaded once per Python worker; ``special`` makes special strings in texts special tokens."""
    return per_worker(("byte pieces", path, special), lambda: BytePieces(path, special))


def model_pieces(path: str) -> ModelPieces:
    """Loaded once per Python worker."""
    return per_worker(("model pieces", path), lambda: ModelPieces(path))
