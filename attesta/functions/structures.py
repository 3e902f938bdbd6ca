"""Atoms of molecular formulas and of SMILES, as column expressions.

A formula tells every atom.  SMILES leaves most hydrogens out, and how many there
are follows from valences, which need a toolkit: only the atoms that are written
are counted, those hydrogens included that stand in brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols of the elements in the order of their numbers, fixed values.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
_KIND = "array<struct<symbol: string, n: bigint>>"


def atomic_number(symbol: Column) -> Column:
    """Number of an element; null for what is none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, ELEMENTS)), symbol).cast("int"), F.lit(0))


def _summed(parts: Column) -> Column:
    """An entry for each symbol in the order of the symbols, counts added up; null if a symbol is no element."""
    symbols = F.array_sort(F.array_distinct(F.transform(parts, lambda p: p["symbol"])))
    total = lambda s: F.aggregate(F.filter(parts, lambda p: p["symbol"] == s), F.lit(0).cast("bigint"), lambda t, p: t + p["n"])
    known = F.forall(symbols, lambda s: F.array_contains(F.array(*map(F.lit, ELEMENTS)), s))
    return F.when(known, F.transform(symbols, lambda s: F.struct(s.alias("symbol"), total(s).alias("n")))).cast(_KIND)


def formula_atoms(formula: Column) -> Column:
    """Array of (symbol, n) of a formula like ``C9H8O4`` or ``C2H4NO2-``; null if it is none. A charge at the end does not count."""
    f = F.regexp_replace(formula, r"^\s+|\s+$", "")
    tokens = F.regexp_extract_all(F.regexp_replace(f, r"[+-]\d*$", ""), F.lit(r"([A-Z][a-z]?\d*)"), 1)
    n = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(\d+)$", 1), F.lit("")).cast("bigint"), F.lit(1).cast("bigint"))
    parts = F.transform(tokens, lambda t: F.struct(F.regexp_extract(t, "^([A-Z][a-z]?)", 1).alias("symbol"), n(t).alias("n")))
    return F.when(f.rlike(r"^(?:[A-Z][a-z]?\d{0,9})+(?:[+-]\d{0,3})?$"), _summed(parts))


def smiles_atoms(smiles: Column) -> Column:
    """Array of (symbol, n) of the atoms that a SMILES writes, aromatic ones in lower case included; null without any or with an unknown one."""
    tokens = F.regexp_extract_all(smiles, F.lit(r"(\[[^\]]*\]|Cl|Br|[BCNOPSFI]|[bcnops])"), 1)
    bare = lambda t: F.regexp_extract(t, r"^\[?\d*([A-Z][a-z]?|se|as|te|[bcnops])", 1)
    capital = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1))
    atom = lambda t: F.struct(capital(bare(t)).alias("symbol"), F.lit(1).cast("bigint").alias("n"))
    held = lambda t: F.regexp_extract(t, r"^\[\d*(?:[A-Z][a-z]?|se|as|te|[bcnops])@*(H\d*)", 1)
    count = lambda h: F.when(h == "H", 1).otherwise(F.substring(h, 2, 9).try_cast("bigint")).cast("bigint")
    hydrogens = F.transform(F.filter(tokens, lambda t: held(t) != ""), lambda t: F.struct(F.lit("H").alias("symbol"), count(held(t)).alias("n")))
    return F.when(F.size(tokens) > 0, _summed(F.concat(F.transform(tokens, atom), hydrogens)))


def compound_elements(compounds: DataFrame, key: str, formula: str | None = None, smiles: str | None = None) -> DataFrame:
    """(key, element_id, symbol, atom_count) of compounds: of the formula, or without a readable one of the atoms that the SMILES writes."""
    sources = [formula_atoms(F.col(formula))] if formula else []
    sources += [smiles_atoms(F.col(smiles))] if smiles else []
    found = compounds.select(key, F.explode(F.coalesce(*sources)).alias("a"))
    return found.select(key, atomic_number(F.col("a.symbol")).alias("element_id"), F.col("a.symbol").alias("symbol"), F.col("a.n").alias("atom_count"))
