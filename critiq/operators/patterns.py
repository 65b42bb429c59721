"""Which texts contain which of many passages, in one walk of each text.

The passages of a pass, bounded by their length, travel with the tasks. Each task builds one
Aho-Corasick automaton of them and reads every text once, whatever the number of passages.
More passages are split by measured hash parts into further passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from critiq.operators.scan_topk import query_passes
from critiq.session import small_batches

# Characters of passages that one automaton holds.
CHARACTERS_PER_PASS = 1_000_000
_PAIRS_PER_BATCH = 10_000


def containing(
    documents: DataFrame,
    passages: DataFrame,
    *,
    id_column: str,
    text_column: str,
    passage_column: str,
    passage_text_column: str,
    characters_per_pass: int = CHARACTERS_PER_PASS,
) -> DataFrame:
    """``passage_column, id_column`` where a document's text contains a passage's text.

    Compared sign by sign. The empty passage is in every text; missing passages and texts
    are in no pair.
    """
    wanted = passages.select(passage_column, F.col(passage_text_column).alias("_passage"))
    wanted = wanted.filter(F.col("_passage").isNotNull())
    texts = documents.select(id_column, text_column).filter(F.col(text_column).isNotNull())
    found = [
        _in_one_walk(texts, part, passage_column, id_column)
        for part in query_passes(wanted, passage_column, _characters, characters_per_pass)
    ]
    return reduce(DataFrame.unionByName, found)


def _characters(passages: DataFrame) -> int:
    return passages.agg(F.coalesce(F.sum(F.length("_passage")), F.lit(0))).head()[0]


def _automaton(passages: list[str]) -> tuple[ahocorasick.Automaton | None, list[int]]:
    """Automaton whose values are the numbers of equal passages, and those that are empty."""
    places: dict[str, list[int]] = {}
    for number, passage in enumerate(passages):
        places.setdefault(passage, []).append(number)
    empty = places.pop("", [])
    if not places:
        return None, empty
    automaton = ahocorasick.Automaton()
    for passage, numbers in places.items():
        automaton.add_word(passage, numbers)
    automaton.make_automaton()
    return automaton, empty


def _in_one_walk(
    texts: DataFrame, passages: DataFrame, passage_column: str, id_column: str
) -> DataFrame:
    table = passages.toArrow().combine_chunks()
    ids = table[passage_column].combine_chunks()
    shared = texts.sparkSession.sparkContext.broadcast((ids, table["_passage"].to_pylist()))
    schema = StructType([passages.schema[passage_column], texts.schema[id_column]])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passage_ids, wanted = shared.value
        automaton, empty = _automaton(wanted)
        for batch in batches:
            rows: list[int] = []
            numbers: list[int] = []

            def pairs() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [passage_ids.take(pa.array(numbers, pa.int64())).cast(kinds[0]),
                     batch.column(0).take(pa.array(rows, pa.int64())).cast(kinds[1])],
                    names=schema.names,
                )

            for row, text in enumerate(batch.column(1)):
                held = set(empty)
                if automaton is not None:
                    for _, equal in automaton.iter(text.as_py()):
                        held.update(equal)
                numbers += sorted(held)
                rows += [row] * len(held)
                if len(rows) >= _PAIRS_PER_BATCH:
                    yield pairs()
                    rows, numbers = [], []
            yield pairs()

    small_batches(texts.sparkSession)
    return texts.mapInArrow(walk, schema)
