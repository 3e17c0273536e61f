"""The database's configuration: a JSON document with sequence groups, and the folders of a database and of results."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass
class Group:
    sequence_files: list[str] = field(default_factory=list)
    phylogeny_path: str | None = None
    k: int | None = None
    s: int | None = None


@dataclass
class Config:
    name: str = "database"
    groups: dict[str, Group] = field(default_factory=lambda: {"default": Group()})
    phylogeny_path: str | None = None
    k: int | None = None
    n: int | None = None
    s: int | None = None
    pile: int | None = None

    @classmethod
    def load(cls, path: str) -> Config:
        """Missing values keep their defaults."""
        with open(path) as f:
            raw = json.load(f)
        groups = {k: Group(**v) for k, v in raw.pop("groups", {}).items()} or {"default": Group()}
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        return cls(**known, groups=groups)

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2)

    def set(self, **values) -> None:
        for k, v in values.items():
            if k not in ("k", "n", "s", "pile", "phylogeny_path", "name"):
                raise KeyError(k)
            setattr(self, k, v)

    def new_group(self, name: str) -> Group:
        return self.groups.setdefault(name, Group())

    def group_set(self, name: str, **values) -> None:
        for k, v in values.items():
            if k not in ("k", "s", "phylogeny_path"):
                raise KeyError(k)
            setattr(self.groups[name], k, v)

    def group_get(self, name: str) -> tuple[int | None, int | None, list[str]]:
        """(k, s, files); k and s fall back to the database's."""
        g = self.groups[name]
        return g.k if g.k is not None else self.k, g.s if g.s is not None else self.s, list(g.sequence_files)

    def add_sequences(self, files: list[str], group: str = "default") -> None:
        own = {os.path.abspath(f) for f in files}
        for name, g in self.groups.items():
            if name != group and (twice := own & set(g.sequence_files)):
                raise ValueError(f"already in group {name}: {sorted(twice)[:3]}")
        g = self.new_group(group)
        g.sequence_files = sorted(set(g.sequence_files) | own)

    def remove_sequences(self, files: list[str], group: str | None = None) -> None:
        gone = {os.path.abspath(f) for f in files}
        for name, g in self.groups.items():
            if group in (None, name):
                g.sequence_files = [f for f in g.sequence_files if f not in gone]

    def remove_group(self, name: str) -> None:
        del self.groups[name]

    def paths(self) -> list[str]:
        return sorted({f for g in self.groups.values() for f in g.sequence_files})

    def build_params(self) -> tuple[int, str, list[str]]:
        if self.k is None or self.phylogeny_path is None:
            raise ValueError("k and phylogeny_path must be set")
        return self.k, self.phylogeny_path, self.paths()

    def __str__(self) -> str:
        lines = [f"<<< Database {self.name} >>>", "", f"phylogeny\t-->\t{self.phylogeny_path}", f"k\t\t-->\t{self.k}", f"n\t\t-->\t{self.n}", f"sketch\t\t-->\t{self.s}", f"pile\t\t-->\t{self.pile}"]
        for name in sorted(self.groups):
            k, s, files = self.group_get(name)
            lines += ["", f"group {name}: k={k}, sketch={s}, sequences={len(files)}"]
        return "\n".join(lines)


@dataclass(frozen=True)
class DatabaseFolders:
    root: str

    @property
    def config(self) -> str:
        return f"{self.root}/config.json"

    @property
    def kmers(self) -> str:
        return f"{self.root}/kmers"

    @property
    def nodes(self) -> str:
        return f"{self.root}/nodes"

    @property
    def accessions(self) -> str:
        return f"{self.root}/accession_ids"

    @property
    def phylogeny(self) -> str:
        return f"{self.root}/phylogeny"

    def missing(self) -> list[str]:
        """What a database that is to be read lacks."""
        return [p for p in (self.root, self.config, self.phylogeny) if not Path(p).exists()]

    def create(self) -> None:
        Path(self.root).mkdir(parents=True, exist_ok=True)
        Path(self.phylogeny).mkdir(exist_ok=True)


@dataclass(frozen=True)
class ResultFolders:
    root: str

    def of(self, kind: str, name: str) -> str:
        """kind: phy or tax; name: raw, summary, classified, split."""
        if kind not in ("phy", "tax") or name not in ("raw", "summary", "classified", "split", "counts"):
            raise ValueError((kind, name))
        return f"{self.root}/{kind}/{name}"
