"""Featurizers for structures: a protocol, a pure fallback, and RDKit where it can be imported."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATOM = re.compile(r"\[[^\]]*\]|Br|Cl|[BCNOPSFIbcnops]")
SCHEMA = "smiles string, ok boolean, reason string, heavy_atoms int, rings int, hetero int, fragments int, bits array<long>"


class Featurizer(Protocol):
    def features(self, smiles: str) -> dict: ...


class TextFeaturizer:
    """Counts and hashed substrings of the text itself; no chemistry is claimed."""

    def __init__(self, bits: int = 256, longest: int = 4):
        self.bits, self.longest = bits, longest

    def features(self, smiles: str) -> dict:
        import xxhash

        s = "".join((smiles or "").split())
        if not s:
            return {"ok": False, "reason": "empty"}
        if s.count("(") != s.count(")") or s.count("[") != s.count("]"):
            return {"ok": False, "reason": "unbalanced"}
        words = np.zeros(self.bits // 64, np.uint64)
        for n in range(2, self.longest + 1):
            for i in range(len(s) - n + 1):
                h = xxhash.xxh64_intdigest(s[i : i + n]) % self.bits
                words[h // 64] |= np.uint64(1) << np.uint64(h % 64)
        atoms = [a for a in ATOM.findall(s) if a not in ("[H]", "[H+]", "[2H]")]
        return {
            "ok": True, "reason": None, "heavy_atoms": len(atoms), "rings": len(set(re.findall(r"%\d\d|\d", re.sub(r"\[[^\]]*\]", "", s)))),
            "hetero": sum(a.strip("[]@+-H").upper()[:1] not in ("C", "") or a in ("Cl",) for a in atoms), "fragments": s.count(".") + 1, "bits": words.view(np.int64).tolist(),
        }


def rdkit_featurizer():
    """An RDKit featurizer, or None where RDKit is not installed."""
    try:
        from rdkit import Chem
        from rdkit.Chem import rdFingerprintGenerator
    except ImportError:
        return None

    class RdkitFeaturizer:
        def features(self, smiles: str) -> dict:
            mol = Chem.MolFromSmiles(smiles or "")
            if mol is None:
                return {"ok": False, "reason": "parse_failed"}
            bits = rdFingerprintGenerator.GetMorganGenerator(radius=2, fpSize=2048).GetFingerprint(mol)
            words = np.packbits(np.array(list(bits), np.uint8), bitorder="little").view(np.int64)
            return {
                "ok": True, "reason": None, "heavy_atoms": mol.GetNumHeavyAtoms(), "rings": mol.GetRingInfo().NumRings(),
                "hetero": sum(a.GetAtomicNum() not in (1, 6) for a in mol.GetAtoms()), "fragments": len(Chem.GetMolFrags(mol)), "bits": words.tolist(),
            }

    return RdkitFeaturizer()


def featurize(df: DataFrame, column: str, featurizer: Featurizer | None = None) -> DataFrame:
    """One row per distinct structure with its features; failures keep their reason instead of ending the job."""
    f = featurizer or TextFeaturizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for pdf in batches:
            rows = []
            for s in pdf["smiles"]:
                try:
                    row = f.features(s)
                except Exception as e:  # one bad structure is a row with a reason
                    row = {"ok": False, "reason": type(e).__name__}
                rows.append([s, *[row.get(n) for n in names[1:]]])
            out = pd.DataFrame(rows, columns=names)
            for c in ("heavy_atoms", "rings", "hetero", "fragments"):
                out[c] = out[c].astype("Int32")
            yield out

    return df.select(F.col(column).alias("smiles")).where("smiles IS NOT NULL").distinct().mapInPandas(run, SCHEMA)
