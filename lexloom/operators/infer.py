"""Model calls as a batch operator, with deterministic stand-ins for work without a network."""
from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

Client = Callable[[list[str]], list[str | None]]


def _with_retries(call: Client, prompts: list[str], tries: int, pause: float) -> list[str | None]:
    for attempt in range(1, tries + 1):
        try:
            return call(prompts)
        except Exception:  # noqa: BLE001 - any failure of a remote call is retried
            if attempt < tries:
                time.sleep(pause * attempt)
    return [None] * len(prompts)


def batch_infer(df: DataFrame, prompt: str, out: str, make_client: Callable[[], Client], batch: int = 10, tries: int = 3,
                pause: float = 1.0, concurrency: int | None = None) -> DataFrame:
    """Adds the model's reply to every row; null after ``tries`` failures with growing pauses.

    The client is built once per task; ``concurrency`` bounds the tasks and with them the
    calls in flight.
    """
    source = df.repartition(concurrency) if concurrency else df
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            replies: list[str | None] = []
            prompts = pdf[prompt].tolist()
            for at in range(0, len(prompts), batch):
                replies += _with_retries(client, prompts[at:at + batch], tries, pause)
            yield pdf.assign(**{out: replies})

    return source.mapInPandas(run, f"{fields}, `{out}` string")


def fill_template(template: str, **cols: Column) -> Column:
    """Prompt text with ``{name}`` places filled from columns; templates belong to the caller."""
    out = F.lit(template)
    for name, col in cols.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col.cast("string"), F.lit("")))
    return out


def judge_score(reply: Column) -> Column:
    """0-100 from a judge's reply, clamped; 50 when there is no number."""
    number = F.nullif(F.regexp_extract(reply, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(number, F.lit(50))))


# ------------------------------------------------------------------ embeddings

_LEGAL = {"article", "chapter", "section", "law", "decree", "clause", "tax"}
HASHED = "hashed"


def _bucket_weights(text: str, dim: int) -> np.ndarray:
    """Hashed word counts: legal words and numbers count double, a number after a legal word 1.5 times."""
    v, prev = np.zeros(dim), ""
    for w in re.findall(r"\w+", text.lower()):
        weight = 2.0 if w in _LEGAL or w.isdigit() else 1.0
        if w.isdigit() and prev in _LEGAL:
            weight *= 1.5
        v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") % dim] += weight
        prev = w
    n = np.linalg.norm(v)
    return v / n if n else v


def hashed_words(dim: int = 384) -> Callable[[], Callable[[list[str]], list]]:
    """The provider that needs no model: unit vectors of hashed word counts."""
    return lambda: lambda texts: [_bucket_weights(t, dim) for t in texts]


def embed(text: Column, providers: list[tuple[str, Callable[[], Callable[[list[str]], list]]]] | None = None) -> Column:
    """struct<provider, vector> of texts; blank text gives null.

    ``providers``: (name, function that builds a model), in order of preference; hashed word
    counts if none are given. A model is built once per task. Where one fails on a batch, the
    next takes the whole batch, and its name says which vector space the vectors are in: keep
    one column or table per provider. With no provider left the job fails.
    """
    chosen = providers if providers is not None else [(HASHED, hashed_words())]

    @F.pandas_udf("struct<provider:string,vector:array<float>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models: dict[str, Callable] = {}
        for texts in batches:
            blank = (texts.isna() | (texts.str.strip() == "")).to_numpy()
            asked, name, vectors, failures = texts[~blank].tolist(), None, [], []
            for name, make in chosen if asked else []:
                try:
                    if name not in models:
                        models[name] = make()
                    vectors = [np.asarray(v, dtype="float32") for v in models[name](asked)]
                    break
                except Exception as exc:  # noqa: BLE001 - the next provider may still answer
                    failures.append(f"{name}: {type(exc).__name__}: {exc}")
            else:
                if asked:
                    raise RuntimeError("no embedding provider left: " + "; ".join(failures))
            out = pd.DataFrame({"provider": [None] * len(texts), "vector": [None] * len(texts)}, dtype=object)
            at = np.flatnonzero(~blank)
            for i, v in zip(at, vectors):
                out.at[i, "provider"], out.at[i, "vector"] = name, v
            yield out
    found = run(text)
    return F.when(found["vector"].isNotNull(), found)


def embedding_model(corpus: DataFrame, text: str, dim: int = 384):
    """Fitted text -> unit TF-IDF vector pipeline of hashed words, all in the JVM."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"[\p{L}\p{N}]+", gaps=False),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dim),
        IDF(inputCol="__tf", outputCol="__idf"),
        Normalizer(inputCol="__idf", outputCol="__unit"),
    ]
    return Pipeline(stages=stages).fit(corpus)


def embedded(model, df: DataFrame, out: str = "embedding") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return model.transform(df).withColumn(out, vector_to_array("__unit", "float32")).drop("__words", "__tf", "__idf", "__unit")


def synthetic_questions(chunks: DataFrame, document: str, order: str, make_client: Callable[[], Client], template: str, first: int = 5) -> DataFrame:
    """Questions a model writes for the first chunks of each document, one row per question."""
    from lexloom.functions.text import json_array_in
    from lexloom.operators.ordered import top_k
    picked = top_k(chunks, [document], [F.col(order)], first, "__n").withColumn("__prompt", fill_template(template, content=F.col("content")))
    asked = batch_infer(picked, "__prompt", "__reply", make_client)
    return asked.select(document, order, F.explode(json_array_in(F.col("__reply"))).alias("question"))
