"""Chat formatting by perspective rotation: every participant's view of a conversation, with training masks.

For each participant the dialogue is rendered with that speaker as the assistant and all others as named users; turns of
the instructing roles (system) stay what they are. The result has one row for each view and turn, with its place in the
rendered dialogue and the part of it that is trained on, so that no conversation, however long, has to fit into one row
or task: concatenating `rendered` by `start` gives the dialogue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.llm.common import own_columns
from presslake.llm.mixing import FAN, LEVELS, running_sum

# The markers of the chat layout.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
MARK, DEFUSED = "<|im_", "< |im_"


def spoken(column: Column, absent: str) -> Column:
    """Text for a rendering: a null as absent, and no markers of the layout."""
    return F.replace(F.coalesce(column, F.lit(absent)), F.lit(MARK), F.lit(DEFUSED))


def rotate(turns: DataFrame, instructing: Sequence[str] = ("system",), conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, turn, speaker, role, name, rendered, start, mask_start, mask_end) of every view.

    start counts the characters of the dialogue before the turn; [mask_start, mask_end) is the trained part of the
    dialogue, the assistant's words and the end of the turn, and null for other turns. Turns are in order of turn, then
    role, then text, nulls last. A null conv_id is one more conversation, a null role one more speaker, called unknown,
    a null text an empty turn. Repeated rows are repeated turns. Markers inside texts and names are defused. A
    conversation in which only instructing roles speak has no views.
    """
    rows = own_columns(turns, conv_id=conv_col, turn=turn_col, speaker=role_col, text=text_col)
    rows = rows.withColumns({"conv_key": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")),
                             "speaker_key": F.coalesce(F.concat(F.lit("="), "speaker"), F.lit(""))})
    instructs = F.coalesce(F.col("speaker").isin(*instructing), F.lit(False)) if instructing else F.lit(False)
    views = rows.where(~instructs).select("conv_key", F.col("speaker").alias("perspective"), F.col("speaker_key").alias("view")).distinct()
    seen = rows.join(views, "conv_key")
    own = F.col("speaker_key") == F.col("view")
    role = F.when(instructs, F.col("speaker")).when(own, "assistant").otherwise("user")
    name = F.when(~instructs & ~own, spoken(F.col("speaker"), "unknown"))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    seen = seen.withColumns({"role": role, "name": name, "head": head, "body": F.concat(spoken(F.col("text"), ""), F.lit(CLOSE))})
    seen = seen.withColumn("rendered", F.concat("head", "body")).withColumn("size", F.length("rendered").cast("long"))
    # Turns of one conversation are spread evenly over the places of the running sum, by the range of turns seen.
    low, high = rows.agg(F.min("turn"), F.max("turn")).first()
    span = (high - low + 1) if low is not None else 1
    place = F.coalesce((F.col("turn") - F.lit(low)) * F.lit(float(FAN**LEVELS - 1)) / F.lit(float(span)), F.lit(float(FAN**LEVELS - 1)))
    order = [F.col(c).asc_nulls_last() for c in ("turn", "speaker", "text")]
    done = running_sum(seen, ["conv_key", "view"], place, order, "size", "end")
    return done.select(
        "conv_id", "perspective", "turn", "speaker", "role", "name", "rendered",
        (F.col("end") - F.col("size")).alias("start"),
        F.when(own, F.col("end") - F.col("size") + F.length("head")).alias("mask_start"),
        F.when(own, F.col("end")).alias("mask_end"),
    )
