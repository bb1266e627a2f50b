"""Versions of ranking models, and which of them are in use."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

from ..operators.ranking import Trees, read_trees
from .folders import Folder

POINTERS = ("current", "candidate")


class Models:
    """Models as folders <domain>/<version>, which are never changed, and as pointers <domain>/current and candidate."""

    def __init__(self, spark: SparkSession, root: str):
        self._folder = Folder(spark, root)

    def versions(self, domain: str) -> list[str]:
        return [n for n in self._folder.names(domain) if n not in POINTERS and not n.startswith(("_", "."))]

    def save(self, domain: str, version: str, dump: dict, features: list[str], metrics: dict) -> None:
        """Keeps a dumped model with its features and metrics; a version that is there is an error."""
        for name in (domain, version):
            if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name) or name in POINTERS:
                raise ValueError(f"{name!r} cannot name a domain or version")
        hidden = f"_{uuid.uuid4().hex}"
        self._folder.put(f"{hidden}/model.json", json.dumps(dump))
        self._folder.put(f"{hidden}/metadata.json", json.dumps({"features": features, "metrics": metrics}, sort_keys=True))
        if not self._folder.move(hidden, f"{domain}/{version}"):
            raise FileExistsError(f"{domain} has a version {version}")

    def point(self, domain: str, version: str, pointer: str = "current") -> None:
        """Makes a version the current one or the candidate, as promotion and rollback do; it must exist."""
        if pointer not in POINTERS or version not in self.versions(domain):
            raise LookupError(f"no pointer {pointer} or no version {version} of {domain}")
        self._folder.put(f"{domain}/{pointer}", version)

    def pointed(self, domain: str, pointer: str = "current") -> str | None:
        return self._folder.text(f"{domain}/{pointer}")

    def publish(self, domain: str, version: str, dump: dict, features: list[str], metrics: dict, candidate: bool, promoted: bool) -> None:
        """Keeps a model and sets the pointers that the gate's decision (`monitoring.gate`) allows."""
        self.save(domain, version, dump, features, metrics)
        for pointer, allowed in (("candidate", candidate), ("current", promoted)):
            if allowed:
                self.point(domain, version, pointer)

    def load(self, domain: str, version: str, features: list[str]) -> Trees:
        """The trees of a version; an error if it was trained on other features, or on these in another order."""
        about, dump = (self._folder.text(f"{domain}/{version}/{n}.json") for n in ("metadata", "model"))
        if about is None or dump is None:
            raise LookupError(f"no version {version} of {domain}")
        names, trees = read_trees(json.loads(dump))
        if json.loads(about)["features"] != features or (names and names != features):
            raise ValueError(f"version {version} of {domain} has other features")
        return trees

    def choose(self, domain: str, ranker: str, features: list[str]) -> tuple[str, Trees] | None:
        """Name and trees of the model that ranks: for `model:candidate` the candidate, else, as for `model`, the current one.

        None, which stands for the heuristic score, if `ranker` is another word, or if no model that it allows is there and fits.
        """
        allowed = {"model": ("current",), "model:candidate": ("candidate", "current")}.get(ranker, ())
        for pointer in allowed:
            version = self.pointed(domain, pointer)
            try:
                if version is not None:
                    return f"{domain}/{version}", self.load(domain, version, features)
            except (LookupError, ValueError, KeyError):
                continue  # refused: the next one ranks
        return None
