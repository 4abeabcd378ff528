"""Packed identifiers: ``sample * 10^12 + chromosome * 10^9 + position`` in one BIGINT, and derived names."""

from __future__ import annotations

# Fixed values of the packed-id layout.
SAMPLE_UNIT = 1_000_000_000_000
CHROM_UNIT = 1_000_000_000
REGION_SAMPLE_UNIT = 100_000_000_000

# Fixed numbers of the chromosomes that are not numbered by name.
NAMED_CHROMOSOMES = {"X": 23, "Y": 24, "MT": 25}

NEW_REGION_PREFIX = "NEWREG"
NEW_REGION_WIDTH = 15


def chrom_number(chrom: str) -> str:
    """``chr7`` -> 7, ``chrX`` -> 23; NULL for a name that has no number."""
    name = f"regexp_replace({chrom}, '^chr', '')"
    named = " ".join(f"WHEN '{label}' THEN {value}" for label, value in NAMED_CHROMOSOMES.items())
    return f"(CASE {name} {named} ELSE try_cast({name} AS INT) END)"


def chrom_name(number: str) -> str:
    named = " ".join(f"WHEN {value} THEN '{label}'" for label, value in NAMED_CHROMOSOMES.items())
    return f"concat('chr', CASE {number} {named} ELSE cast({number} AS STRING) END)"


def pack_position(sample_id: str, chrom_num: str, pos: str) -> str:
    return (
        f"(cast({sample_id} AS BIGINT) * {SAMPLE_UNIT} + cast({chrom_num} AS BIGINT) * {CHROM_UNIT} "
        f"+ cast({pos} AS BIGINT))"
    )


def sample_of(packed: str) -> str:
    return f"cast({packed} div {SAMPLE_UNIT} AS INT)"


def strip_sample(packed: str) -> str:
    return f"({packed} % {SAMPLE_UNIT})"


def strip_region_sample(packed_region: str) -> str:
    return f"({packed_region} % {REGION_SAMPLE_UNIT})"


def chrom_number_of(position_id: str) -> str:
    """Chromosome number of a position id whose sample part has been stripped."""
    return f"cast({position_id} div {CHROM_UNIT} AS INT)"


def to_coordinates(position_id: str) -> str:
    """Position id without sample -> ``struct(chrom, pos)``."""
    chrom = chrom_name(chrom_number_of(position_id))
    return f"named_struct('chrom', {chrom}, 'pos', cast({position_id} % {CHROM_UNIT} AS INT))"


def stable_id(prefix: str, number: str, digits: int = 11) -> str:
    """Numeric region id -> stable identifier, e.g. prefix ``ENSE`` and 42 -> ``ENSE00000000042``."""
    text = f"cast({number} AS STRING)"
    return f"concat('{prefix}', lpad({text}, greatest({digits}, length({text})), '0'))"


def new_region_id(number: str) -> str:
    """Running number -> ``NEWREG`` name, zero-filled to 15 characters and never cut."""
    return stable_id(NEW_REGION_PREFIX, number, NEW_REGION_WIDTH - len(NEW_REGION_PREFIX))
