"""Providers from model folders on disk: token counters, embedders and rerankers.

A folder holds ``tokenizer.json`` and, for models, ``model.onnx`` and
``config.json`` with its ``max_position_embeddings``. Nothing is downloaded.
Weights are loaded on first use, once per worker, so that a provider travels as
its path.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from pathlib import Path

import numpy as np

from .providers import WINDOW

_LOADED: dict[tuple[str, str], object] = {}


def quiet() -> None:
    """No threads of the tokenizer's own beside a worker's, and no notes of the runtime below errors."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    try:
        import onnxruntime
    except ImportError:
        return
    onnxruntime.set_default_logger_severity(3)


def _once(kind: str, path: str, load):
    if (kind, path) not in _LOADED:
        quiet()
        _LOADED[kind, path] = load()
    return _LOADED[kind, path]


def _tokenizer(folder: str):
    def load():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(str(Path(folder) / "tokenizer.json"))

    return _once("tokenizer", folder, load)


def _session(folder: str):
    def load():
        import onnxruntime

        return onnxruntime.InferenceSession(str(Path(folder) / "model.onnx"), providers=["CPUExecutionProvider"])

    return _once("model", folder, load)


class TokenizerCounter:
    """Tokens of a text without special ones."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def __call__(self, text: str) -> int:
        return len(_tokenizer(self.folder).encode(text, add_special_tokens=False).ids)


class _Onnx:
    def __init__(self, folder: str, name: str, revision: str, window: int) -> None:
        self.folder, self.name, self.revision, self.window = folder, name, revision, window

    def _run(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(the first output, the attention mask) of texts or pairs of them, cut at the window."""
        tokenizer, session = _tokenizer(self.folder), _session(self.folder)
        rows = [(e.ids[: self.window], e.type_ids[: self.window]) for e in tokenizer.encode_batch(texts)]
        width = max(len(ids) for ids, _ in rows)
        padded = lambda k: np.array([r[k] + [0] * (width - len(r[k])) for r in rows], np.int64)
        mask = np.array([[1] * len(ids) + [0] * (width - len(ids)) for ids, _ in rows], np.int64)
        given = {"input_ids": padded(0), "attention_mask": mask, "token_type_ids": padded(1)}
        wanted = {i.name for i in session.get_inputs()}
        return session.run(None, {k: v for k, v in given.items() if k in wanted})[0], mask


class OnnxEmbedder(_Onnx):
    """Unit vectors: the mean of the tokens' states."""

    def encode(self, texts: list[str]) -> np.ndarray:
        states, mask = self._run(list(texts))
        mean = (states * mask[..., None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class OnnxReranker(_Onnx):
    """The first logit of each pair."""

    def predict(self, pairs: Iterable[tuple[str, str]]) -> np.ndarray:
        pairs = [tuple(p) for p in pairs]
        return self._run(pairs)[0].reshape(len(pairs), -1)[:, 0] if pairs else np.empty(0)


def load_token_counter(folder: str) -> TokenizerCounter:
    """The counter of a folder's tokenizer; missing files are errors at once, not on a worker."""
    if not (Path(folder) / "tokenizer.json").is_file():
        raise FileNotFoundError(f"{folder}/tokenizer.json")
    return TokenizerCounter(str(folder))


def _model(kind, folder: str, window: int | None):
    load_token_counter(folder)
    at = Path(folder)
    if not (at / "model.onnx").is_file():
        raise FileNotFoundError(f"{folder}/model.onnx")
    config = json.loads((at / "config.json").read_text(encoding="utf-8"))
    own = int(config.get("max_seq_length") or config["max_position_embeddings"])
    if window is not None and own != window:
        raise ValueError(f"the model in {folder} reads {own} tokens, chunks are made for {window}")
    digest = hashlib.sha256()
    with (at / "model.onnx").open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return kind(str(folder), str(config.get("_name_or_path") or at.name), digest.hexdigest()[:12], own)


def load_embedder(folder: str, window: int = WINDOW) -> OnnxEmbedder:
    """The embedder of a folder; one whose window isn't the one that chunks are made for is an error."""
    return _model(OnnxEmbedder, folder, window)


def load_reranker(folder: str) -> OnnxReranker:
    """The reranker of a folder."""
    return _model(OnnxReranker, folder, None)
