"""Report orchestration - every export of a segmentation run.

Tables of a run (executors write their partitions directly):
  segments, segments_csv   card features + segment label (Parquet, CSV)   R04
  summary                  segment summary table (Parquet)                R03
  technical                one JSON document: quality metrics, model runs, config   R05
  insights                 one JSON document per segment                  R02
  insights_summary         their summary                                  R06
They lie in a folder of the run and become visible together, by a manifest that
is renamed last (``sources.sinks.Bundle``).  Errors propagate (nothing is
swallowed into a False return) and leave the last complete report in place.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardprism.config import SegmentationConfig
from cardprism.operators import reports as RP
from cardprism.operators.features import attach_labels
from cardprism.operators.quality import quality_report
from cardprism.sources.sinks import Bundle, save_documents, save_table, save_text


def export_report(features: DataFrame, labels: DataFrame, points: DataFrame, runs: DataFrame | None,
                  path: str, cfg: SegmentationConfig = SegmentationConfig(), algorithm: str = "", run_id: str | None = None) -> dict:
    """``labels``: (card_id, cluster); ``points``: (id, v) clustering matrix.
    Returns the tables' paths.  A ``run_id`` that is complete already is returned
    as it stands; readers find the paths by ``read_manifest(spark, path)``."""
    bundle = Bundle(features.sparkSession, path, run_id or uuid.uuid4().hex)
    if (done := bundle.done()) is not None:
        return done
    seg = attach_labels(features, labels.withColumnRenamed("cluster", "segment"), "segment")
    at = save_table(seg, bundle.path("segments"), "parquet")
    seg = features.sparkSession.read.schema(seg.schema).parquet(at)   # computed once, read by all that follows
    save_table(seg, bundle.path("segments_csv"), "csv")
    save_table(RP.segment_summary(seg), bundle.path("summary"), "parquet")
    pts = points.join(labels.select(F.col("card_id").alias("id"), "cluster"), "id")
    metrics = quality_report(pts, algorithm).first().asDict()
    tech = {"timestamp": datetime.datetime.now(datetime.timezone.utc).isoformat(), "algorithm": algorithm,
            "quality_metrics": metrics,
            "model_runs": [r.asDict() for r in runs.collect()] if runs is not None else [],
            "config": {k: (list(v) if isinstance(v, tuple) else v) for k, v in cfg.to_dict().items()}}
    spark = features.sparkSession
    doc = spark.createDataFrame([(json.dumps(tech, ensure_ascii=False, default=str),)], "value string")
    save_text(doc, bundle.path("technical"))
    ins = RP.insight_rules(RP.segment_stats(seg))
    save_documents(ins, bundle.path("insights"), key_col="segment")
    save_table(RP.insight_summary(ins), bundle.path("insights_summary"), "json")
    return bundle.commit()
