"""Functions of file and set names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The chromatin states that end a set's name.
CHROMATIN_STATES = (
    "Active_TSS", "Flanking_Active_TSS", "Strong_transcription", "Weak_transcription", "Enhancers", "Genic_enhancers",
    "ZNF_genes_and_repeats", "Heterochromatin", "Bivalent_Poised_TSS", "Flanking_Bivalent_TSS_Enh", "Bivalent_Enhancer",
    "Repressed_PolyComb", "Weak_Repressed_PolyComb", "Transcr_at_gene_5_and_3", "Quiescent_Low",
)


def strip_extensions(name: Column, k: int = 1) -> Column:
    """The last part of a path without its last k dot-suffixes."""
    base = F.substring_index(name, "/", -1)
    parts = F.split(base, r"\.")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - k, F.lit(1))), ".")


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def clean_name(name: Column) -> Column:
    """Without .tsv, .gz and .bed at the end, in that order."""
    return F.regexp_replace(name, r"(\.bed)?(\.gz)?(\.tsv)?$", "")


def split_name(name: Column, states: tuple[str, ...] = CHROMATIN_STATES) -> Column:
    """(cell, state): the longest known state that ends the name, and what stands before it less one character; else an error."""
    out = F.raise_error(F.concat(F.lit("no known state: "), name)).cast("struct<cell:string,state:string>")
    for state in sorted(states, key=lambda s: (len(s), s)):
        found = F.struct(F.substring(name, F.lit(1), F.length(name) - len(state) - 1).alias("cell"), F.lit(state).alias("state"))
        out = F.when(name.endswith(state), found).otherwise(out)
    return out


def with_bed_extension(path: str, exists) -> str:
    """The path itself or with .gz added or taken off, or .bed(.gz) added: the first that exists."""
    tries = [path, path.removesuffix(".gz") if path.endswith(".gz") else f"{path}.gz", f"{path}.bed", f"{path}.bed.gz"]
    for one in tries:
        if exists(one):
            return one
    raise FileNotFoundError(path)


def number_of(name: Column, known: Sequence[str]) -> Column:
    """Place of a name in a list that the caller gives, from 0; an unknown name is an error, null stays null."""
    at = F.array_position(F.array(*[F.lit(k) for k in known]), name)
    return F.when(at > 0, at - 1).when(name.isNotNull(), F.raise_error(F.concat(F.lit("unknown name: "), name)).cast("long"))


def state_number(state: Column) -> Column:
    return number_of(state, CHROMATIN_STATES)


def set_number(name: Column, cells: Sequence[str]) -> Column:
    """Number of a cell_state set when cells are listed in order and each cell has all states in theirs."""
    parts = split_name(name)
    return number_of(parts["cell"], cells) * len(CHROMATIN_STATES) + state_number(parts["state"])


#: The tissue categories that plots tell apart.
PLOT_CATEGORIES = ("brain", "skin", "lung", "digestive")


def plot_category(category: Column) -> Column:
    """The category if its name holds one that plots tell apart, else null."""
    return F.when(F.lower(category).rlike("|".join(PLOT_CATEGORIES)), category)
