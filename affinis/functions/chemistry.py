"""Chemistry functions at the edge; they need RDKit or Open Babel on the workers and say so where it is missing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RESULT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("err", T.StringType())])


def _rdkit():
    try:
        from rdkit import Chem
    except ImportError as e:
        raise RuntimeError("this function needs RDKit on every worker") from e
    return Chem


@F.pandas_udf(_RESULT)
def standard_smiles(smiles: pd.Series) -> pd.DataFrame:
    """Parent fragment without charges, as a struct (ok, value, err)."""
    chem = _rdkit()
    from rdkit.Chem.MolStandardize import rdMolStandardize as std

    rows = []
    for s in smiles:
        mol = chem.MolFromSmiles(s) if s else None
        if mol is None:
            rows.append((False, None, "unreadable"))
            continue
        try:
            rows.append((True, chem.MolToSmiles(std.Uncharger().uncharge(std.FragmentParent(mol))), None))
        except Exception as e:  # noqa: BLE001 the reason is data here
            rows.append((False, None, type(e).__name__))
    return pd.DataFrame(rows, columns=["ok", "value", "err"])


@F.pandas_udf(T.IntegerType())
def heavy_atoms(smiles: pd.Series) -> pd.Series:
    """Heavy atoms; NULL for an unreadable structure."""
    chem = _rdkit()
    mols = [chem.MolFromSmiles(s) if s else None for s in smiles]
    return pd.Series([m.GetNumHeavyAtoms() if m else None for m in mols], dtype="Int32")


@F.pandas_udf(T.StringType())
def murcko_scaffold(smiles: pd.Series) -> pd.Series:
    """The scaffold; '' for acyclic molecules, NULL for unreadable ones."""
    chem = _rdkit()
    from rdkit.Chem.Scaffolds.MurckoScaffold import MurckoScaffoldSmiles

    return pd.Series([MurckoScaffoldSmiles(mol=m) if (m := chem.MolFromSmiles(s or "")) else None for s in smiles])
