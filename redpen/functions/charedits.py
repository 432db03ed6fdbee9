"""Character edits given as parallel arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from redpen.functions.arrays import bind


def apply_char_edits(text: Column, edits: Column) -> Column:
    """Replace character ranges left to right.

    A null replacement deletes; an edit that starts before the last one ended
    copies nothing in between; after editing, double spaces collapse once.
    Text without edits is returned as it is.
    """
    steps = F.arrays_zip(
        edits["start"].alias("s"), edits["end"].alias("e"), edits["text"].alias("t")
    )

    def edited(row: Column) -> Column:
        def piece(edit: Column, k: Column) -> Column:
            at = F.when(k == 0, F.lit(0)).otherwise(F.get(row["steps"], k - 1)["e"])
            kept = F.when(edit["s"] > at, F.substring(row["text"], at + 1, edit["s"] - at)).otherwise("")
            return F.concat(kept, F.coalesce(edit["t"], F.lit("")))

        last = F.element_at(row["steps"], -1)["e"]
        rest = F.substring(row["text"], last + 1, F.length(row["text"]))
        pieces = F.array_join(F.transform(row["steps"], piece), "")
        return F.replace(F.concat(pieces, rest), F.lit("  "), F.lit(" "))

    none = F.coalesce(F.size(edits["start"]), F.lit(0)) <= 0
    return F.when(none, text).otherwise(bind({"text": text, "steps": steps}, edited))
