"""Which texts contain which patterns: a substring join in one pass over the texts for each block of patterns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of patterns that go to the tasks at a time; more take more passes over the texts.
BLOCK_BYTES = 8 << 20


def containing(texts: DataFrame, text_col: str, patterns: DataFrame, pattern_col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, text, pattern), distinct: each text with each of the patterns of equal keys that it contains, of any characters.

    A task holds the patterns of a block as an Aho-Corasick automaton and reads each text once. An
    empty pattern is in every text; nulls match nothing. Blocks are cut by the patterns' hashes, so one holds
    BLOCK_BYTES or little more, whatever their number; a pattern that is longer must fit in memory.
    """
    wanted = patterns.select(*keys, F.col(pattern_col).alias("pattern")).filter("pattern is not null").distinct()
    size = wanted.agg(F.sum(F.octet_length("pattern") + 16)).head()[0] or 0
    rows = texts.select(*keys, F.col(text_col).alias("text")).filter("text is not null").distinct()
    schema = StructType([*rows.schema.fields, StructField("pattern", StringType())])
    passes, out = 1 + size // BLOCK_BYTES, None
    for k in range(passes):
        block = wanted.filter(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k).collect()  # BLOCK_BYTES, as counted above
        shared = texts.sparkSession.sparkContext.broadcast([(tuple(r[:-1]), r[-1]) for r in block])

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton, always = ahocorasick.Automaton(), set()
            of: dict[str, set[tuple]] = {}
            for key, pattern in shared.value:
                of.setdefault(pattern, set()).add(key)
            always = of.pop("", set())
            for pattern, own in of.items():
                automaton.add_word(pattern, (pattern, own))
            automaton.make_automaton()
            for f in frames:
                found = []
                for row in f.itertuples(index=False):
                    key, text = tuple(row[:-1]), row[-1]
                    hits = {p for _, (p, own) in automaton.iter(text) if key in own} if of else set()
                    if key in always:
                        hits.add("")
                    found += [(*key, text, p) for p in hits]
                yield pd.DataFrame(found, columns=schema.names)

        one = rows.mapInPandas(run, schema)
        out = one if out is None else out.unionByName(one)
    return out
