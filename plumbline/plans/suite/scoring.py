"""Scoring of observations; runs, claims and statuses are made from the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import scoring as s
from plumbline.plans.suite import query, table
from plumbline.sources.local import inline_rows

# Claims by (conv_id + turn) % 6, statuses by turn % 3; one run per conv_id % 5.
_CLAIMS = [
    "La valeur 999 de vitesse_limite est suspecte", "Il manque des mois : trou dans la série",
    "BE est un excès net, point chaud", "ZH n'est pas un excès, sous-représenté",
    "Le volume baisse donc moins de danger", "Coordonnées hors emprise ABE, excès",
]
_STATUSES = ["fait", "hypothèse", "refusé"]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_OBS = f"""(SELECT conv_id % 5 AS run, ([{", ".join(_quoted(c) for c in _CLAIMS)}])[(conv_id + turn) % 6 + 1] || ' ' || text AS claim,
  ([{", ".join(_quoted(c) for c in _STATUSES)}])[turn % 3 + 1] AS statut FROM conversations)"""


def observed(spark, folder):
    def pick(values, at):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))

    return table(spark, folder, "conversations").select(
        (F.col("conv_id") % 5).alias("run"),
        F.concat(
            pick(_CLAIMS, (F.col("conv_id") + F.col("turn")) % 6), F.lit(" "), "text"
        ).alias("claim"),
        pick(_STATUSES, F.col("turn") % 3).alias("statut"),
    )


def _any_sql(terms) -> str:
    return "(" + " OR ".join(f"contains(lower(claim), {_quoted(t.lower())})" for t in terms) + ")"


_CHECKS = {
    "sentinel": (("999", "vitesse_limite"), ("fait",)),
    "temporal": (("trou", "manquant", "série", "volume", "collecte", "rupture"), ("fait",)),
    "spatial": (("emprise", "coordonn", "géom", "geom", "0,0", "null-island", "suisse"), ("fait",)),
    "concentration": (("type_route", "point chaud"), ("hypothèse", "fait")),
}


def _check_sql(terms, statuses) -> str:
    return f"{_any_sql(terms)} AND statut IN ({', '.join(_quoted(t) for t in statuses)})"


_RUNS = " UNION ALL ".join(
    f"SELECT '{name}' AS \"check\", count(*) FILTER (WHERE hit) AS n FROM (SELECT run, bool_or({_check_sql(*spec)}) AS hit FROM {_OBS} GROUP BY 1)"
    for name, spec in _CHECKS.items()
)


@query("score_runs", _RUNS)
def score_runs(spark, folder):
    return s.runs_matching(
        observed(spark, folder), {n: s.has_keyword(*spec) for n, spec in _CHECKS.items()}
    )


@query(
    "score_forbidden",
    f"""SELECT 'safety' AS "check", count(*) FILTER (WHERE {_any_sql(s.SAFETY_TERMS)} AND {_any_sql(s.TREND_TERMS)} AND statut = 'fait') AS n FROM {_OBS}
    UNION ALL SELECT 'severity', count(*) FILTER (WHERE {_any_sql(["mois"])} AND {_any_sql(["grav"])} AND statut = 'fait') FROM {_OBS}""",
)
def score_forbidden(spark, folder):
    return s.observations_matching(
        observed(spark, folder),
        {
            "safety": s.mentions_both(s.SAFETY_TERMS, s.TREND_TERMS),
            "severity": s.mentions_both(["mois"], ["grav"]),
        },
    )


def _excess_sql(unit: str) -> str:
    return rf"regexp_matches(claim, '(^|[^\p{{L}}\p{{N}}_]){unit}($|[^\p{{L}}\p{{N}}_])') AND {_any_sql(s.EXCESS_TERMS)} AND NOT {_any_sql(s.NEGATION_TERMS)} AND statut = 'fait'"


@query(
    "score_excess",
    " UNION ALL ".join(
        f"SELECT '{unit}' AS \"check\", count(*) FILTER (WHERE {_excess_sql(unit)}) AS n FROM {_OBS}" for unit in ("BE", "ZH")
    ),
)
def score_excess(spark, folder):
    return s.observations_matching(
        observed(spark, folder), {unit: s.asserted_excess(unit) for unit in ("BE", "ZH")}
    )


@query(
    "score_gate",
    f"""WITH c AS ({_RUNS} UNION ALL SELECT 'ZH', count(*) FILTER (WHERE {_excess_sql("ZH")}) FROM {_OBS}),
    t("check", at_least, at_most) AS (VALUES ('sentinel', 4, NULL), ('temporal', 4, NULL), ('spatial', 4, NULL), ('ZH', NULL, 0), ('absent', 1, NULL))
    SELECT t."check", coalesce(c.n, 0) AS n, CAST(at_least AS BIGINT) AS at_least, CAST(at_most AS BIGINT) AS at_most,
    coalesce(coalesce(c.n, 0) >= at_least, true) AND coalesce(coalesce(c.n, 0) <= at_most, true) AS passed FROM t LEFT JOIN c USING ("check")""",
)
def score_gate(spark, folder):
    obs = observed(spark, folder)
    counts = s.runs_matching(obs, {n: s.has_keyword(*spec) for n, spec in _CHECKS.items()}).unionByName(
        s.observations_matching(obs, {"ZH": s.asserted_excess("ZH")})
    )
    thresholds = inline_rows(
        spark,
        "check string, at_least bigint, at_most bigint",
        [("sentinel", s.QUORUM, None), ("temporal", s.QUORUM, None), ("spatial", s.QUORUM, None), ("ZH", None, 0), ("absent", 1, None)],
    )
    return s.threshold_gate(counts, thresholds)
