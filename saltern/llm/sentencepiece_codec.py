"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no piece of the vocabulary has a whitespace marker after another character, no merge can
cross the boundary before a marker. A text, with its markers, is then a sequence of chunks (a run
of markers and what follows it), and a text's ids are its chunks' ids joined by position. Chunks are
counted over the whole corpus; of the distinct ones, each of the ``TABLE_ROWS`` most frequent (up to
``TABLE_CHUNK`` characters) is segmented once, and the table of their ids goes to every task: its
size is bounded for any corpus. A chunk outside the table is segmented where it stands, once for
each time that a task's own table of such chunks, of as many rows, begins anew. (To join those by
position too would shuffle every rare word twice, with its text.) A model with pieces that cross
markers is used on whole texts instead.

Defined results: a null text counts as empty; an empty text has no ids and decodes to "".
Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import array
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltern.llm.common import small_batches

MARK = "▁"
#: Chunks that one worker's table holds, and the longest chunk (characters) that it keeps.
TABLE_ROWS, TABLE_CHUNK = 50_000, 64
#: Texts of so many bytes (a single longer text aside) are segmented and handed back together.
BATCH_BYTES = 2 << 20

_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


Table = tuple[dict[str, bytes], dict[str, str]]


def _bytes(ids: list[int]) -> bytes:
    return array.array("i", ids).tobytes()


class ChunkTable:
    """Distinct marked word -> (ids as 32-bit bytes, decoded text): the corpus's table, and one filled
    as other chunks are met."""

    def __init__(self, model: bytes, rows: int = TABLE_ROWS, corpus: Table = ({}, {})):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rows, (self.corpus_ids, self.corpus_texts) = rows, corpus
        self._restart({}, {})
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.mark_id = self.sp.piece_to_id(MARK)
        self.bounded = (
            self.sp.id_to_piece(self.mark_id) == MARK
            and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
            and self.sp.encode("a  b ") == [*self.sp.encode("a"), *self.sp.encode(" b"), self.mark_id]
        )

    def _restart(self, ids: dict[str, bytes], texts: dict[str, str]) -> None:
        self.ids, self.texts = self.corpus_ids | ids, self.corpus_texts | texts

    def segment(self, chunks: list[str]) -> Table:
        """Ids and decoded texts of distinct chunks, in one call of the library each."""
        ids = [x or [self.mark_id] for x in self.sp.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)]
        return dict(zip(chunks, map(_bytes, ids), strict=True)), dict(zip(chunks, (" " + t for t in self.sp.decode(ids, num_threads=1)), strict=True))

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids, and what they decode to. The texts' new chunks are segmented together."""
        if not self.bounded:
            for text in texts:
                ids = self.sp.encode(text)
                yield _bytes(ids), self.sp.decode(ids)
            return
        split = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        missing = list(set().union(*split).difference(self.ids))
        new_ids, new_texts = self.segment(missing) if missing else ({}, {})
        kept = [c for c in missing if len(c) <= TABLE_CHUNK]
        own = self.rows + len(self.corpus_ids)
        if len(self.ids) + len(kept) > own:
            seen = set().union(*split).intersection(self.ids)  # of the old table, what these texts need
            self._restart({c: self.ids[c] for c in seen}, {c: self.texts[c] for c in seen})
        self.ids.update(new_ids)
        self.texts.update(new_texts)
        for chunks in split:
            yield b"".join(map(self.ids.__getitem__, chunks)), "".join(map(self.texts.__getitem__, chunks))[1:]
        if len(kept) < len(missing):
            for c in set(missing).difference(kept):
                del self.ids[c], self.texts[c]
        if len(self.ids) > own:
            self._restart({}, {})


def corpus_table(df: DataFrame, model: bytes, text: str = "text", rows: int = TABLE_ROWS) -> Table:
    """Ids and decoded texts of the ``rows`` most frequent chunks of all texts, each segmented once."""
    chunks = F.regexp_extract_all(F.concat(F.lit(MARK), F.replace(F.col(f"`{text}`"), F.lit(" "), F.lit(MARK))), F.lit(_CHUNK.pattern), 0)
    counts = df.filter(F.col(f"`{text}`") != "").select(F.explode(chunks).alias("chunk")).filter(F.char_length("chunk") <= TABLE_CHUNK).groupBy("chunk").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "chunk").limit(rows).select("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for batch in batches:
            own = batch.column("chunk").to_pylist()
            ids, texts = table.segment(own) if own else ({}, {})
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array([ids[c] for c in own], pa.binary()), pa.array([texts[c] for c in own], pa.string())], names=["chunk", "ids", "decoded"])

    found = top.mapInArrow(run, "chunk string, ids binary, decoded string").toArrow().to_pydict()
    return dict(zip(found["chunk"], found["ids"], strict=True)), dict(zip(found["chunk"], found["decoded"], strict=True))


def _mapper(model: bytes, text_at: int, schema: pa.Schema, rows: int, corpus: Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for whole in batches:
            table = table or ChunkTable(model, rows, corpus)
            lengths = [len(x.as_buffer()) if x.is_valid else 0 for x in whole.column(text_at)]
            start = 0
            while start < whole.num_rows:
                end, size = start + 1, lengths[start]
                while end < whole.num_rows and size + lengths[end] <= BATCH_BYTES:
                    size += lengths[end]
                    end += 1
                batch = whole.slice(start, end - start)
                ids, offsets, decoded = [], [0], []
                for own, text in table.encode([x or "" for x in batch.column(text_at).to_pylist()]):
                    ids.append(own)
                    offsets.append(offsets[-1] + len(own) // 4)
                    decoded.append(text)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(decoded, pa.string())], names=[*schema.names])
                start = end

    return run


def encode_decode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", table_rows: int = TABLE_ROWS) -> DataFrame:
    """``df`` with the ids of each whole text and the text that the ids decode to.

    ``model_path`` is read on the driver and travels with the tasks (about 0.5 MB), as the table does. Columns named
    like ``ids`` or ``decoded`` are replaced.
    """
    small_batches(df.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    keep = [c for c in df.columns if c not in (ids, decoded)]
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    names = pa.schema([(f.name, pa.null()) for f in schema.fields])
    corpus = corpus_table(df, model, text, table_rows) if ChunkTable(model).bounded else ({}, {})
    return df.mapInArrow(_mapper(model, keep.index(text), names, table_rows, corpus), schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of any ids; null ids give null."""
    with open(model_path, "rb") as f:
        model = f.read()

    @F.pandas_udf(T.StringType())
    def text_of(column):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        return column.map(lambda x: None if x is None else sp.decode([int(i) for i in x]))

    return df.withColumn(decoded, text_of(F.col(f"`{ids}`")))
