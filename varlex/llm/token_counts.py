"""Token counts without encoding: strings proven to be one token are counted as they are."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex.llm.common import BoundedCache, chunked_matches, documents, inputs, per_worker

LIMIT = 4096
SPACE = "▁"  # stands for a blank in pieces
# Marks a proven cut in front of a pre-token: no piece of the vocabulary holds it beside another character.
CUT = "\n"


class Counter:
    """Counts for one piece model, loaded once per Python worker.

    The proof reads the vocabulary only.  A merge joins neighbours into a
    piece, so two characters that are neighbours in no piece are never joined:
    a text may be cut between them and its parts counted alone.  Cut are
    (1) around line ends, (2) in front of a blank after anything else, and
    (3) between a letter and those punctuation marks that follow a letter in
    no piece; each is checked here, and only cuts that hold are used.  A
    vocabulary string is *whole* if the model gives it back as itself; such
    a pre-token counts as one token.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [
            self.model.id_to_piece(i)
            for i in range(size)
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))
        ]
        joined = "\0".join(pieces)
        if self.model.normalize(f" a  b{CUT}Åﬁ ") != f" a  b{CUT}Åﬁ ".replace(" ", SPACE).join((SPACE, "")):
            raise ValueError("the cuts are proven for models that keep texts as they are")
        if re.search(f"[^{SPACE}\0]{SPACE}|.{CUT}|{CUT}.", joined.replace("\0" + CUT + "\0", "\0")):
            raise ValueError("a piece spans a blank or a line end")
        marks = [c for c in ",.;:!?)(\"'*#$%&|<>" if not re.search(f"[^\\W\\d_]{re.escape(c)}", joined)]
        ends = f"(?=[{re.escape(''.join(marks))}{CUT}])" if marks else f"(?={CUT})"
        self.pattern = re.compile(f"{CUT}|{SPACE}*[^\\W\\d_]+{ends}|{SPACE}*[^{SPACE}{CUT}]+|{SPACE}+")
        self.line_end = len(self.model.encode(CUT)) - 1
        # The model sees its own blank in front and the mark behind it, whose tokens are taken off.
        ids = self._alone(pieces)
        self.whole = {p for p, n in zip(pieces, ids) if n == 1}
        self.counts = BoundedCache()

    def _alone(self, pre_tokens: list[str]) -> list[int]:
        """Tokens of each pre-token by the model's own merges."""
        found = self.model.encode([CUT + p.replace(SPACE, " ") for p in pre_tokens], num_threads=1)
        return [len(ids) - 1 - self.line_end for ids in found]

    def learn(self, pre_tokens: Iterable[str]) -> None:
        """Merge the pre-tokens that are neither whole nor known."""
        missing = list(self.counts.missing(set(pre_tokens).difference(self.whole)))
        if missing:
            self.counts.update(zip(missing, self._alone(missing)))

    def total(self, pre_tokens: list[str]) -> int:
        rest = list(filterfalse(self.whole.__contains__, pre_tokens))
        return len(pre_tokens) - len(rest) + sum(map(self.counts.__getitem__, rest))

    def counted(self, texts: list[str]) -> list[int]:
        """Tokens of each text; texts that aren't long are learned together."""
        # The model puts one blank in front of every text.
        texts = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        short = [self.pattern.findall(t) if len(t) <= 1 << 20 else None for t in texts]
        self.learn(chain.from_iterable(p for p in short if p))
        found = [self.total(p) if p is not None else 0 for p in short]
        for k, text in enumerate(texts):
            if short[k] is None:
                for chunk in chunked_matches(self.pattern, text):
                    self.learn(chunk)
                    found[k] += self.total(chunk)
        return found


def counter(path: str) -> Counter:
    """Loaded once per Python worker."""
    return per_worker(("pieces", path), lambda: Counter(path))


def token_counts(
    docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Counts are those of the model's library, without begin or end.  Null and
    empty texts have no bytes and no tokens; long texts are counted in chunks
    of pre-tokens; special strings are ordinary text.  Repeated rows and equal
    or null doc_ids keep one row each; other columns are not read; an empty
    table gives no rows.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in batches:
            counts = model.counted(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = inputs(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    counted = rows.mapInArrow(scan, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
