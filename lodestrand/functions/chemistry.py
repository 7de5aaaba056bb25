"""Chemistry of structures by RDKit: standardization, descriptors, scaffolds, graphs. Each needs RDKit on the executors; there is
no fallback, because counts of text do not stand for chemistry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STANDARD = "standardized_smiles string, reason string, molecular_weight double, heavy_atom_count int, is_mixture boolean, is_inorganic boolean"
DESCRIPTORS = (
    "heavy_atom_count int, ring_count int, aromatic_ring_count int, molecular_weight double, clogp double, hbond_donor_count int, hbond_acceptor_count int, tpsa double, rotatable_bond_count int, "
    "formal_charge int, fraction_csp3 double, heteroatom_count int, num_valence_electrons int, murcko_scaffold string, generic_murcko_scaffold string, generic_of_scaffold string, parse_success boolean"
)
GRAPH = "atoms array<array<double>>, bonds array<struct<begin:int,end:int,features:array<double>>>, n_atoms int, n_bonds int, reason string"


@dataclass(frozen=True)
class Steps:
    """What standardization does, in this order."""

    cleanup: bool = True
    fragment_parent: bool = True
    largest_fragment: bool = False
    normalize: bool = False
    uncharge: bool = False
    canonical: bool = True
    reject_mixtures: bool = True


def available() -> bool:
    from importlib.util import find_spec

    return find_spec("rdkit") is not None


def per_structure(df: DataFrame, column: str, make: Callable[[], Callable[[str], dict]], schema: str) -> DataFrame:
    """`column` and what a function says of it, one row per distinct non-null structure. `make` is called once a task, where it
    may build what is costly to build; a structure that it fails on is a row with the error's name as its reason."""
    names = [x.split()[0] for x in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = make()
        for pdf in batches:
            out = []
            for s in pdf[column]:
                try:
                    row = of(s)
                except Exception as e:
                    row = {"reason": f"error:{type(e).__name__}"}
                out.append([s, *[row.get(n) for n in names]])
            yield pd.DataFrame(out, columns=[column, *names], dtype=object)

    return df.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, f"{column} string, {schema}")


def _fields(schema: str) -> list[str]:
    """The fields of a schema text, split at the commas outside angle brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return out


def standardize(df: DataFrame, column: str, steps: Steps = Steps()) -> DataFrame:
    """Standardized structures with weight, size, mixture and inorganic marks, or the reason why there is none."""

    def make() -> Callable[[str], dict]:
        from rdkit import Chem
        from rdkit.Chem import Descriptors
        from rdkit.Chem.MolStandardize import rdMolStandardize as tools

        chain = [
            (steps.cleanup, tools.Cleanup), (steps.fragment_parent, tools.FragmentParent), (steps.largest_fragment, tools.LargestFragmentChooser().choose),
            (steps.normalize, tools.Normalizer().normalize), (steps.uncharge, tools.Uncharger().uncharge),
        ]

        def of(raw: str) -> dict:
            text = raw.strip()
            mol = Chem.MolFromSmiles(text) if text else None
            if mol is None:
                return {"reason": "invalid_smiles" if text else "missing_smiles"}
            for wanted, step in chain:
                mol = step(mol) if wanted else mol
                if mol is None or not mol.GetNumAtoms():
                    return {"reason": "no_parent_fragment" if mol is None else "empty_parent_fragment"}
            Chem.SanitizeMol(mol)
            smiles = Chem.MolToSmiles(mol, canonical=steps.canonical)
            if steps.reject_mixtures and "." in smiles:
                return {"reason": "mixture_after_standardization"}
            return {
                "standardized_smiles": smiles, "molecular_weight": float(Descriptors.MolWt(mol)), "heavy_atom_count": mol.GetNumHeavyAtoms(),
                "is_mixture": "." in text or len(Chem.GetMolFrags(mol)) > 1, "is_inorganic": all(a.GetAtomicNum() != 6 for a in mol.GetAtoms()),
            }

        return of

    return per_structure(df, column, make, STANDARD)


def describe(df: DataFrame, column: str) -> DataFrame:
    """Thirteen descriptors, the Murcko scaffold, and generic scaffolds both of the molecule and of its scaffold."""

    def make() -> Callable[[str], dict]:
        from rdkit import Chem
        from rdkit.Chem import Crippen, Descriptors, Lipinski, rdMolDescriptors
        from rdkit.Chem.Scaffolds import MurckoScaffold as murcko

        def text(mol) -> str | None:
            return Chem.MolToSmiles(mol) if mol is not None and mol.GetNumAtoms() else None

        def of(smiles: str) -> dict:
            mol = Chem.MolFromSmiles(smiles)
            if mol is None:
                return {"parse_success": False}
            rings = mol.GetRingInfo().AtomRings()
            scaffold = murcko.GetScaffoldForMol(mol)
            return {
                "heavy_atom_count": mol.GetNumHeavyAtoms(), "ring_count": len(rings), "aromatic_ring_count": sum(all(mol.GetAtomWithIdx(i).GetIsAromatic() for i in r) for r in rings),
                "molecular_weight": float(Descriptors.MolWt(mol)), "clogp": float(Crippen.MolLogP(mol)), "hbond_donor_count": Lipinski.NumHDonors(mol), "hbond_acceptor_count": Lipinski.NumHAcceptors(mol),
                "tpsa": float(rdMolDescriptors.CalcTPSA(mol)), "rotatable_bond_count": Lipinski.NumRotatableBonds(mol), "formal_charge": Chem.GetFormalCharge(mol), "fraction_csp3": float(rdMolDescriptors.CalcFractionCSP3(mol)),
                "heteroatom_count": rdMolDescriptors.CalcNumHeteroatoms(mol), "num_valence_electrons": Descriptors.NumValenceElectrons(mol), "parse_success": True,
                "murcko_scaffold": text(scaffold), "generic_murcko_scaffold": text(murcko.MakeScaffoldGeneric(mol)), "generic_of_scaffold": text(murcko.MakeScaffoldGeneric(scaffold)) if scaffold.GetNumAtoms() else None,
            }

        return of

    return per_structure(df, column, make, DESCRIPTORS)


def graphs(df: DataFrame, column: str) -> DataFrame:
    """Atoms with eight features (number, degree, charge, aromatic, hydrogens, in a ring, implicit valence, mass / 100), and bonds, both
    ways, with six (single, double, triple, aromatic, conjugated, in a ring)."""

    def make() -> Callable[[str], dict]:
        from rdkit import Chem

        kinds = (Chem.BondType.SINGLE, Chem.BondType.DOUBLE, Chem.BondType.TRIPLE, Chem.BondType.AROMATIC)

        def of(smiles: str) -> dict:
            mol = Chem.MolFromSmiles(smiles)
            if mol is None or not mol.GetNumAtoms():
                return {"n_atoms": 0, "n_bonds": 0, "reason": "invalid_smiles"}
            atoms = [[*map(float, (a.GetAtomicNum(), a.GetDegree(), a.GetFormalCharge(), a.GetIsAromatic(), a.GetTotalNumHs(), a.IsInRing(), a.GetImplicitValence())), a.GetMass() / 100] for a in mol.GetAtoms()]
            bonds = []
            for b in mol.GetBonds():
                features = [*(float(b.GetBondType() == k) for k in kinds), float(b.GetIsConjugated()), float(b.IsInRing())]
                i, j = b.GetBeginAtomIdx(), b.GetEndAtomIdx()
                bonds += [{"begin": i, "end": j, "features": features}, {"begin": j, "end": i, "features": features}]
            return {"atoms": atoms, "bonds": bonds, "n_atoms": len(atoms), "n_bonds": len(bonds) // 2}

        return of

    return per_structure(df, column, make, GRAPH)
