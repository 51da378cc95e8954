"""Functions for SQL users: ``register(spark)`` makes them temporary functions of the session.

They are SQL functions, not Python ones: the optimizer puts their bodies into the plan, so they are as fast as what
they stand for. The last one gives a table and is used with LATERAL.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_NAMES = "array('C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B')"

#: name -> parameters, type of the result, body.
FUNCTIONS = {
    "strophe_hz_to_midi": ("hz double", "double", "case when hz > 0 then 69 + 12 * log2(hz / 440) end"),
    "strophe_midi_to_hz": ("midi double", "double", "440 * power(2D, (midi - 69) / 12)"),
    "strophe_nearest_note": ("midi double", "int", "cast(floor(midi + 0.5D) as int)"),
    "strophe_cents": ("midi double", "double", "(midi - floor(midi + 0.5D)) * 100"),
    "strophe_note_name": ("note int", "string", f"concat(element_at({_NAMES}, pmod(note, 12) + 1), cast(cast(floor(note / 12) as int) - 1 as string))"),
    "strophe_amplitude_db": ("amplitude double", "double", "20 * log10(greatest(amplitude, 1e-12D))"),
    "strophe_verdict": ("cents double", "string", "case when abs(cents) < 30 then 'clean' when abs(cents) < 70 then 'off' when cents is not null then 'wrong' end"),
    "strophe_substitution": ("semitones double", "double", "1.5D * greatest(0D, least(1D, (abs(semitones) - 0.3D) / 1.7D))"),
}
TABLES = {
    "strophe_ledger_lines": ("staff_position int", "line int", "select explode(case when staff_position <= -2 then sequence(-2, staff_position, -2) when staff_position >= 10 then sequence(10, staff_position, 2) else array() end)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    for name, (parameters, columns, body) in TABLES.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns table ({columns}) return {body}")
    return [*FUNCTIONS, *TABLES]
