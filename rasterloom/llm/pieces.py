"""SentencePiece encoding and decoding with a table of distinct chunks.

No piece of the vocabulary holds a whitespace marker after another character, so no merge crosses the place before a run
of markers. A text is therefore the concatenation of chunks (markers, then other characters), and each distinct chunk is
segmented once; ids and decoded text of a document are put together from the table by position. The table belongs to a
task and is started anew when it holds `max_chunks` chunks, which bounds memory and leaves the results as they are.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Segments distinct chunks once. A chunk is named by its text without the first marker."""

    def __init__(self, model_path: str, max_chunks: int = 200_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if any(re.search(f"[^{MARK}]{MARK}", self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size())):
            raise ValueError("pieces of this vocabulary cross whitespace markers")
        probe = "Ａ  ﬁe\u0301\u00a0x\tB "  # what other normalisers would change
        if self.sp.normalize(probe) != "".join(MARK + c for c in self.chunks(probe)):
            raise ValueError("this model changes characters before it segments them")
        self.max_chunks, self.ids, self.text = max_chunks, {}, {}
        self.start, self.end = struct.pack("<I", self.sp.bos_id()), struct.pack("<I", self.sp.eos_id())

    @staticmethod
    def chunks(text: str) -> list[str]:
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " ":
            return text.split(" ")
        return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.ids]
        if len(self.ids) + len(new) > self.max_chunks:
            self.ids, self.text, new = {}, {}, list(chunks)
        for chunk, ids in zip(new, self.sp.encode(new, num_threads=1) if new else []):
            if not chunk:  # a marker alone; the library encodes an empty text as nothing
                ids = [self.sp.piece_to_id(MARK)]
            self.ids[chunk] = struct.pack(f"<{len(ids)}I", *ids)
            self.text[chunk] = self.sp.decode(ids)

    def encode(self, chunks: list[str]) -> bytes:
        return self.start + b"".join(map(self.ids.__getitem__, chunks)) + self.end

    def decode(self, chunks: list[str]) -> str:
        return " ".join(map(self.text.__getitem__, chunks))


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Ids of every whole text, with begin and end ids, and what they decode to.

    model_path: where the executors find the model. Null and empty texts have the two ids alone; null ids of documents,
    repeated rows and ties are kept as they are, a row for each row; an empty table gives no rows; other columns of the
    input are not looked at. with_ids, with_text: also return the ids and the decoded text.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int64()))] * with_ids + [("decoded", pa.string())] * with_text
    schema = pa.schema(fields)
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids + ", decoded string" * with_text

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model_path)
        for batch in batches:
            for rows, texts in batches_of(batch, "text"):
                split = [chunks.chunks(t) for t in texts]
                chunks.learn(set().union(*split))
                ids = [chunks.encode(c) for c in split]
                decoded = [chunks.decode(c) for c in split]
                out = [rows.column("doc_id"), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x.encode()).hexdigest() for x in decoded]]
                out += [[struct.unpack(f"<{len(x) // 4}I", x) for x in ids]] * with_ids + [decoded] * with_text
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) if isinstance(x, list) else x for x, f in zip(out, schema)], schema=schema)

    return source.mapInArrow(encode, ddl)
