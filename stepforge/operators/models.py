"""Places where a model is called: captions of windows and embeddings of texts, in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

#: Makes a vector of each text; loaded once a task.
Embedder = Callable[[Sequence[str]], "list[list[float]]"]
#: Makes a line of each (path, frame numbers).
Captioner = Callable[[Sequence[tuple[str, list[int]]]], "list[str]"]


def stub_embedder(texts: Sequence[str]) -> list[list[float]]:
    """Eight numbers from a hash of the text; stands in for a model in tests."""
    return [[b / 256 for b in hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()[:8]] for t in texts]


def stub_captioner(windows: Sequence[tuple[str, list[int]]]) -> list[str]:
    """Names the frames of a window; stands in for a model in tests."""
    return [f"{path} frames {' '.join(map(str, frames))}" for path, frames in windows]


def embed(df: DataFrame, key: str, text: str, load: Callable[[], Embedder], batch: int = 64) -> DataFrame:
    """(key, embedding) of each row; null texts are embedded as ''. Results don't depend on the batch size."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for p in parts:
            for at in range(0, len(p), batch):
                some = p.iloc[at : at + batch]
                yield pd.DataFrame({key: some[key], "embedding": model([t or "" for t in some[text]])})

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def caption(df: DataFrame, key: str | Sequence[str], path: str, frames: str, load: Callable[[], Captioner], batch: int = 16) -> DataFrame:
    """(key, line) of each window, one line without line breaks; '' becomes a fixed sentence. The key may be several columns."""
    keys = [key] if isinstance(key, str) else list(key)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for p in parts:
            windows = [(a, list(b)) for a, b in zip(p[path], p[frames], strict=True)]
            lines = [x for at in range(0, len(p), batch) for x in model(windows[at : at + batch])]
            yield p[keys].assign(line=[" ".join(x.split()) or "No description." for x in lines])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return df.select(*keys, path, frames).mapInPandas(run, f"{schema}, line string")
