"""Infrastructure inventory: all railway objects of a cloud and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import railway
from ..operators.cells import beside
from ..session import cut


def inventory(points: DataFrame) -> dict[str, DataFrame]:
    """Wires, droppers, tracks, poles and signals; pole clusters are found once."""
    level = railway.reference_level(points)
    clusters = cut(railway.pole_clusters(points))
    on_poles = railway.signals_on_poles(points, level, clusters)
    signals = railway.deduplicate(on_poles.unionByName(railway.standalone_signals(points, level)))
    return {"wires": cut(railway.wire_segments(points, level=level)), "droppers": cut(railway.droppers(points, level)),
            "tracks": cut(railway.track_segments(points)), "poles": cut(railway.poles(points, clusters=clusters)), "signals": cut(signals),
            "span": railway.span_length(points)}


def summary(parts: dict[str, DataFrame]) -> DataFrame:
    """One row: catenary, tracks, poles and signals."""
    s = lambda df, p: df.select([F.col(c).alias(f"{p}_{c}") for c in df.columns])
    return beside(s(railway.catenary_statistics(parts["wires"], parts["droppers"], parts["span"]), "catenary"),
                  s(railway.track_statistics(parts["tracks"]), "tracks"), s(railway.pole_statistics(parts["poles"]), "poles"),
                  s(railway.signal_statistics(parts["signals"]), "signals"))


def html_rows(total: DataFrame) -> DataFrame:
    """The summary as HTML table rows (pos, line)."""
    pairs = F.array(*[F.format_string(f"<tr><td>{c}</td><td>%s</td></tr>", F.col(c).cast("string")) for c in total.columns])
    return total.select(F.posexplode(pairs).alias("pos", "line")).select(F.col("pos").cast("long"), "line")
