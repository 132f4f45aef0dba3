"""J-9: batch model scoring with an injected predictor.

Rows go to Python in Arrow batches; ``predict(texts) -> texts`` is called
once per batch.  If it fails, its texts are tried one by one, so that one bad
input costs one `ERROR: ...` row; the batch's time is shared among its rows.
No client ships with the engine: the default predictor replays the stored
text, which makes the pipeline deterministic in everything but latency.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomlens.functions.text import parse_prediction


def batch_predict(df: DataFrame, id_col: str, input_col: str,
                  predict: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    fn = predict or (lambda texts: list(texts))

    def one(text):
        try:
            return fn([text])[0] or ""
        except Exception as exc:  # the reference records the failure text
            return f"ERROR: {exc}"

    def run(batches):
        import pandas as pd
        for b in batches:
            texts = b[input_col].tolist()
            start = time.perf_counter()
            try:
                out = [x or "" for x in fn(texts)]
                if len(out) != len(texts):
                    raise ValueError("the predictor returned another number of texts")
            except Exception:
                out = [one(t) for t in texts]
            each = (time.perf_counter() - start) / max(1, len(texts))
            yield pd.DataFrame({id_col: b[id_col], "model_text": out, "latency_s": [each] * len(out)})

    schema = f"{id_col} string, model_text string, latency_s double"
    out = df.select(F.col(id_col).cast("string").alias(id_col), input_col).mapInPandas(run, schema)
    return parse_prediction(out, "model_text", "pred_label")
