"""Token ids of texts by a tokenizer file, for windows of model inputs."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids in an array that goes back to Spark, but for those of its last text.
AT_ONCE = 1 << 16


def token_ids(text: Column, path: str) -> Column:
    """The ids that the file's tokenizer (a .json of the tokenizers library, on every machine) gives, without added tokens; null gives null.

    A worker holds the library's encoding of one text at a time, which takes many times the ids' bytes, and about AT_ONCE ids as numbers."""
    at_once = AT_ONCE

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        for texts in batches:
            ids, starts = array("i"), [0]  # a null start marks a null list, which takes no ids
            for k, t in enumerate(texts, 1):
                if (t := t.as_py()) is None:
                    starts[-1] = None
                else:
                    ids.extend(tok.encode_batch_fast([t], add_special_tokens=False)[0].ids)
                starts.append(len(ids))
                if len(ids) >= at_once or k == len(texts):
                    yield pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)]))
                    ids, starts = array("i"), [0]

    return encode(text)
