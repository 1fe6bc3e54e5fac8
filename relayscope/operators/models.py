"""Scores of text models in the ONNX form, or an honest ``unavailable``.

A model is a folder with ``model.onnx`` and ``tokenizer.json``. It is loaded once per Python worker. A
missing file, a missing library or a load error gives source ``unavailable`` with the reason; scores are
never guessed.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

CLASSIFIER_CHARS, CLASSIFIER_TOKENS, PHISHING_FROM = 2000, 96, 0.5
PERPLEXITY_CHARS, PERPLEXITY_TOKENS, PERPLEXITY_LEAST_TOKENS, LOW_PERPLEXITY = 2000, 256, 8, 35.0


@lru_cache(maxsize=4)
def load(folder: str, length: int, pad: bool):
    """(session, tokenizer, None) or (None, None, reason)."""
    model, words = os.path.join(folder, "model.onnx"), os.path.join(folder, "tokenizer.json")
    if not (os.path.exists(model) and os.path.exists(words)):
        return None, None, "model files not found"
    try:
        import onnxruntime
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(words)
        tokenizer.enable_truncation(length)
        if pad:
            tokenizer.enable_padding(length=length)
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"]), tokenizer, None
    except Exception as e:  # noqa: BLE001 - whatever is wrong with a model, the analysis goes on
        return None, None, f"model failed to load: {e}"


def _logits(session, encoding):
    import numpy as np

    given = {"input_ids": encoding.ids, "attention_mask": encoding.attention_mask, "token_type_ids": encoding.type_ids}
    feed = {i.name: np.array([given[i.name]], np.int64) for i in session.get_inputs() if i.name in given}
    return session.run(None, feed)[0][0]


def _classify(text: str | None, folder: str) -> tuple:
    session, tokenizer, reason = load(folder, CLASSIFIER_TOKENS, True)
    if session is None:
        return "unavailable", None, None, reason
    try:
        logits = _logits(session, tokenizer.encode((text or "")[:CLASSIFIER_CHARS]))
        top = max(logits)
        e = [math.exp(x - top) for x in logits]
        p = e[1] / sum(e)
        return "onnx-model", p, "phishing" if p >= PHISHING_FROM else "legitimate", None
    except Exception as ex:  # noqa: BLE001
        return "unavailable", None, None, f"inference failed: {ex}"


def _perplexity(text: str | None, folder: str) -> tuple:
    session, tokenizer, reason = load(folder, PERPLEXITY_TOKENS, False)
    if session is None:
        return "unavailable", None, False, reason
    try:
        encoding = tokenizer.encode((text or "")[:PERPLEXITY_CHARS])
        if len(encoding.ids) < PERPLEXITY_LEAST_TOKENS:
            return "text-too-short", None, False, None
        logits = _logits(session, encoding)
        loss = 0.0
        for row, token in zip(logits[:-1], encoding.ids[1:]):
            top = max(row)
            loss += top + math.log(sum(math.exp(x - top) for x in row)) - row[token]
        value = math.exp(loss / (len(encoding.ids) - 1))
        return "onnx-model", value, value < LOW_PERPLEXITY, None
    except Exception as ex:  # noqa: BLE001
        return "unavailable", None, False, f"inference failed: {ex}"


def _scored(df: DataFrame, key: str, text: str, one, folder: str, names: list[str], types: list[tuple[str, pa.DataType]]) -> DataFrame:
    narrow = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t, folder) for t in batch.column(1).to_pylist()]
            arrays = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, *names])

    return narrow.mapInArrow(run, ", ".join([f"`{key}` {dict(narrow.dtypes)[key]}", *(f"{n} {t}" for n, (t, _) in zip(names, types))]))


def phishing(df: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """key, phishing_source, phishing_probability, label, detail; the text is subject, blank line, body."""
    return _scored(df, key, text, _classify, folder, ["phishing_source", "phishing_probability", "label", "detail"], [("string", pa.string()), ("double", pa.float64()), ("string", pa.string()), ("string", pa.string())])


def machine_text(df: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """key, ai_text_source, perplexity, low_perplexity_flag, detail of the body."""
    return _scored(df, key, text, _perplexity, folder, ["ai_text_source", "perplexity", "low_perplexity_flag", "detail"], [("string", pa.string()), ("double", pa.float64()), ("boolean", pa.bool_()), ("string", pa.string())])
