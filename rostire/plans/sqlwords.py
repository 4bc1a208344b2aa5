"""SQL that says numbers in Romanian by the grammar's rules, for the oracles."""

from __future__ import annotations

_UNITS = "['unu','doi','trei','patru','cinci','șase','șapte','opt','nouă','zece','unsprezece','doisprezece','treisprezece','paisprezece','cincisprezece','șaisprezece','șaptesprezece','optsprezece','nouăsprezece']"
_TENS = "['', 'douăzeci','treizeci','patruzeci','cincizeci','șaizeci','șaptezeci','optzeci','nouăzeci']"


def _unit(n: str, fem: bool) -> str:
    base = f"({_UNITS})[CAST({n} AS INT)]"
    return f"CASE {n} WHEN 1 THEN 'una' WHEN 2 THEN 'două' WHEN 12 THEN 'douăsprezece' ELSE {base} END" if fem else base


def below_hundred(n: str, fem: bool) -> str:
    """Words of 1 to 99."""
    return f"CASE WHEN {n} < 20 THEN {_unit(n, fem)} WHEN {n} % 10 = 0 THEN ({_TENS})[CAST({n} // 10 AS INT)] ELSE ({_TENS})[CAST({n} // 10 AS INT)] || ' și ' || {_unit(f'({n} % 10)', fem)} END"


def below_thousand(n: str, fem: bool) -> str:
    """Words of 1 to 999."""
    rest = f"({n} % 100)"
    hundreds = f"CASE WHEN {n} >= 200 THEN {_unit(f'({n} // 100)', True)} || ' sute' WHEN {n} >= 100 THEN 'o sută' END"
    return f"concat_ws(' ', {hundreds}, CASE WHEN {rest} > 0 THEN {below_hundred(rest, fem)} END)"


def cardinal(n: str, fem: bool = False) -> str:
    """Words of 0 to 999,999,999."""
    parts = []
    for scale, one, many in ((1_000_000, "un milion", "milioane"), (1000, "o mie", "mii")):
        c = f"({n} // {scale} % 1000)"
        parts.append(f"CASE WHEN {c} = 1 THEN '{one}' WHEN {c} > 1 THEN {below_thousand(c, True)} || CASE WHEN {c} >= 20 THEN ' de {many}' ELSE ' {many}' END END")
    last = f"({n} % 1000)"
    parts.append(f"CASE WHEN {last} > 0 THEN {below_thousand(last, fem)} END")
    return f"CASE WHEN {n} = 0 THEN 'zero' ELSE concat_ws(' ', {', '.join(parts)}) END"


def phrase(n: str, one: str, many: str, fem: bool = False) -> str:
    """Number and noun."""
    return f"CASE WHEN {n} = 0 THEN 'zero {many}' WHEN {n} = 1 THEN '{one}' WHEN {n} < 20 THEN {cardinal(n, fem)} || ' {many}' ELSE {cardinal(n, fem)} || ' de {many}' END"


MONTHS = "['ianuarie','februarie','martie','aprilie','mai','iunie','iulie','august','septembrie','octombrie','noiembrie','decembrie']"


def date(d: str) -> str:
    """A date in words."""
    day = f"CAST(day({d}) AS BIGINT)"
    return f"CASE WHEN {day} = 1 THEN 'întâi' ELSE {cardinal(day)} END || ' ' || ({MONTHS})[month({d})] || ' ' || {cardinal(f'CAST(year({d}) AS BIGINT)')}"
