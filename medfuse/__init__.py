"""medfuse: multimodal patient analytics as Spark DataFrame / ML / Streaming jobs.

Layout
------
- ``sources``    loaders, testdata modality views, scoring records, model store
- ``operators``  profiling, cleaning, joins, split, metrics, ablation, explanation
- ``functions``  column-expression helpers and the time-series feature library
- ``plans``      end-to-end jobs: patient feature matrix, training, batch scoring
- ``streaming``  streaming scoring and windowed wearables features
"""

from medfuse.session import ensure_checkpoint_dir, get_spark_session

__all__ = ["get_spark_session", "ensure_checkpoint_dir"]
