"""Which model words answers, and which embedding is used: settings, registries, checks, and logging.

Everything works offline by default. Other providers are registered by whoever has them; a setting that names an unknown
or keyless one is reported before anything runs.
"""

from __future__ import annotations

import logging
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import LOCAL_DIM, constant_embedding, vector_size
from .embed import embed

Model = Callable[[str], str]
Embedding = Callable[[DataFrame, str, str, int], DataFrame]


def offline_model(prompt: str) -> str:
    """A deterministic stand-in: the first lines of what it was given."""
    lines = [x for x in prompt.splitlines() if x.strip()]
    return "\n".join(["(offline answer)", *lines[:6]])


def constant(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """The same vector for every text that is not null."""
    return df.select(key, F.when(F.col(text).isNotNull(), constant_embedding()).alias("vector"))


#: Providers by name: makers of a model from its settings, and embeddings of a table (key, text, dimensions).
MODELS: dict[str, Callable[[Settings], Model]] = {"mock": lambda s: offline_model, "local": lambda s: offline_model}
EMBEDDINGS: dict[str, Embedding] = {"local": embed, "mock": constant}


@dataclass
class Settings:
    provider: str = "mock"
    model: str = ""
    key_name: str = "API_KEY"
    embedding_provider: str = "local"
    embedding_model: str = ""
    dimensions: int | None = None
    environment: dict[str, str] = field(default_factory=lambda: dict(os.environ), repr=False)

    @classmethod
    def assembled(cls, given: dict, environment: dict[str, str] | None = None) -> Settings:
        """Settings as given, else from LOOMGRAPH_* variables, else the defaults."""
        env = dict(os.environ) if environment is None else environment
        known = {}
        for name in ("provider", "model", "key_name", "embedding_provider", "embedding_model", "dimensions"):
            value = given.get(name) if given.get(name) is not None else env.get(f"LOOMGRAPH_{name.upper()}")
            if value is not None:
                known[name] = int(value) if name == "dimensions" else value
        return cls(**known, environment=env)

    @property
    def offline(self) -> bool:
        return self.provider in ("mock", "local")

    @property
    def dim(self) -> int:
        return vector_size(self.embedding_provider, self.embedding_model, self.dimensions)

    def key(self) -> str | None:
        return self.environment.get(self.key_name)

    def problems(self) -> list[str]:
        """What would keep an index or a question from running with these settings."""
        out = []
        if self.provider not in MODELS:
            out.append(f"unknown provider {self.provider!r}; known: {', '.join(sorted(MODELS))}")
        elif not self.offline and not self.key():
            out.append(f"provider {self.provider!r} needs {self.key_name}")
        if self.embedding_provider not in EMBEDDINGS:
            out.append(f"unknown embedding provider {self.embedding_provider!r}; known: {', '.join(sorted(EMBEDDINGS))}")
        return out

    def make_model(self) -> Model:
        return MODELS[self.provider](self)

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        return EMBEDDINGS[self.embedding_provider](df, key, text, self.dim)

    def stored(self) -> dict:
        """What is written with an index: no key."""
        return {"provider": self.provider, "model": self.model, "key_name": self.key_name, "api_key": None, "embedding_provider": self.embedding_provider, "embedding_model": self.embedding_model, "dim": self.dim}


def describer(model: Model) -> Callable[[list[str]], list[str]]:
    """A model as what enrichment asks for: one or two words for each description."""
    return lambda texts: [model(f"Say in one sentence what this does.\n{t}") for t in texts]


def teed(model: Model, out: Callable[[str], None]) -> Model:
    """A model whose prompts and answers are also told to ``out``."""

    def run(prompt: str) -> str:
        answer = model(prompt)
        out(f"> {prompt.splitlines()[0] if prompt else ''}\n{answer}")
        return answer

    return run


def logger(name: str = "loomgraph", verbose: bool = False) -> logging.Logger:
    """The package's logger, to standard error; told once."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter("%(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    log.setLevel(logging.DEBUG if verbose else logging.WARNING)
    return log


__all__ = ["EMBEDDINGS", "LOCAL_DIM", "MODELS", "Settings", "describer", "logger", "offline_model", "teed"]
