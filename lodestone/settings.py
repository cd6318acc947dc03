"""Settings from the environment, and the preconditions of calls to models."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass


def first_set(names: Sequence[str], env: Mapping[str, str] | None = None) -> str | None:
    """The first variable that is not blank, without white space at its ends."""
    env = os.environ if env is None else env
    return next((v for v in (env.get(n, "").strip() for n in names) if v), None)


@dataclass(frozen=True)
class Settings:
    """Keys of the two model services, model names, and the sizes of the searches."""

    embedding_key: str | None = None
    answer_key: str | None = None
    embedding_model: str = "default"
    answer_model: str = "default"
    top_k: int = 5
    probe_k: int = 20

    @classmethod
    def read(cls, names: Mapping[str, Sequence[str]], env: Mapping[str, str] | None = None) -> Settings:
        """`names` says for each field which variables hold it, in order; fields that none holds keep their default."""
        found = {f: v for f, ns in names.items() if (v := first_set(ns, env)) is not None}
        return cls(**{f: int(v) if f in {"top_k", "probe_k"} else v for f, v in found.items()})

    @property
    def keys_present(self) -> bool:
        return bool(self.embedding_key and self.answer_key)

    def require_keys(self) -> None:
        """Before a client is made: a missing key is an error."""
        if not self.keys_present:
            raise ValueError("the keys of both services are needed")


def embed(question: str, call: Callable[[str], Sequence[Sequence[float]]], settings: Settings) -> list[float]:
    """The question's vector by an injected call; an empty response is an error."""
    settings.require_keys()
    got = call(question)
    if not got or not got[0]:
        raise RuntimeError("the embedding response is empty")
    return [float(x) for x in got[0]]
