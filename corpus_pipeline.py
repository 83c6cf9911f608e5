"""The corpus pipeline: five of the training-data operators, one after the other.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents. The stages are in the
subpackage, so that an installed package has them.
"""

from strandlake.llm.pipeline import ORACLE_SQL, decontaminate, language_filter, near_dedup, pack, quality_filter, run

STAGES = [("quality", quality_filter), ("language", language_filter), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", pack)]

__all__ = ["ORACLE_SQL", "STAGES", "run"]
