"""Fixed-depth grouping (H3): messages meet only within equal length and equal leading words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lineloom.functions.masking import SEP, WILDCARD
from lineloom.operators.mining import Mining, mine_templates
from lineloom.operators.words import word_lines
from lineloom.workspace import Workspace


def drain_lines(messages: DataFrame, depth: int = 4, masks: Sequence[str] = ()) -> DataFrame:
    """``LineId, Bucket, Signature``; the bucket is the length and the first ``depth - 2`` words."""
    lines = word_lines(messages, masks)
    lead = F.substring_index("Signature", SEP, depth - 2) if depth > 2 else F.lit("")
    masked = F.regexp_replace(lead, f"(?U)(?<![^{SEP}])[^{SEP}\\d]*\\d[^{SEP}]*", WILDCARD)
    return lines.withColumn("Bucket", F.concat_ws(SEP, "Bucket", masked))


def mine_drain(
    messages: DataFrame, depth: int = 4, st: float = 0.5, masks: Sequence[str] = (), mode: str = "leader"
) -> Mining:
    """H3: the miners of D2/D3 under a longer key; a leading word with a digit counts as a wildcard in the key."""
    ws = Workspace(messages.sparkSession)
    lines = ws.table(drain_lines(messages, depth, masks), "lines")
    return mine_templates(lines, "seqDist", st, mode=mode, delimiters=False, joint=" ")
