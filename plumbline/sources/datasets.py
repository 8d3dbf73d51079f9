"""Dataset kinds by the files they hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A file that only one kind of dataset has.
MARKS = {"odm": r"(^|/)images/", "tartanair": r"pose_left\.txt$", "eth3d": r"cameras\.txt$", "tum": r"groundtruth\.txt$", "synthetic": r"ground_truth\.json$"}


def kind_of(path: Column) -> Column:
    return F.coalesce(*[F.when(path.rlike(p), k) for k, p in MARKS.items()])
