"""Explicit schemas of every dataset, and the relation dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = ("SubjectEntity", "Relation")

QUERY = "SubjectEntity string, Relation string"
GOLD = QUERY + ", ObjectEntities array<array<string>>"
FLAT_GOLD = QUERY + ", ObjectEntities array<string>"
PREDICTION = FLAT_GOLD
RAW_CACHE = QUERY + ", raw_samples array<string>, sample_statuses array<string>, prompt_variants array<string>, shot_subjects array<string>, shot_subjects_by_sample array<array<string>>, generation_seed decimal(20,0)"
EXEMPLAR = QUERY + ", Question string, think string, Answer string, ObjectEntities array<array<string>>, path int"
TASK = (
    "task_id string, agent_id string, subject string, relation string, input_index bigint, phase string, mode string, prompt string, choices array<string>, choice_codes map<string,string>, "
    "choice_variants array<struct<prompt:string,choice_codes:map<string,string>>>, constant_choice string, n_samples int, temperature double, max_new_tokens int, shot_subjects array<string>"
)
RESPONSE = "task_id string, agent_id string, subject string, relation string, phase string, mode string, generations array<string>, selected_choice string, choice_probabilities map<string,double>"
NODE = QUERY + ", id string, node_type string, model_family string, status string, route string, generation_index int, representative string"
EDGE = QUERY + ", source string, target string, edge_type string"
LINEAR_MODEL = "schema string, relation string, label string, feature_names array<string>, l2 double, coefficients array<double>, mean array<double>, scale array<double>"

# The relation dimension (kind, may be empty, single answer, never empty, share of all samples, share of valid samples).
RELATIONS = (
    ("awardWonBy", "string", False, False, True, 0.10, 0.10),
    ("companyTradesAtStockExchange", "string", True, False, False, 0.35, 0.35),
    ("countryLandBordersCountry", "string", True, False, False, 0.50, 0.25),
    ("personHasCityOfDeath", "string", True, True, False, 0.50, 0.50),
    ("hasArea", "numeric", False, True, True, 0.50, 0.50),
    ("hasCapacity", "numeric", False, True, True, 0.50, 0.50),
)
NUMERIC_RELATIONS = tuple(r[0] for r in RELATIONS if r[1] == "numeric")
SINGLE_RELATIONS = tuple(r[0] for r in RELATIONS if r[3])
NULLABLE_RELATIONS = tuple(r[0] for r in RELATIONS if r[2])

# Evidence families and routes.
FAMILIES = ("qwen_recall", "gemma_independent", "ministral_independent")
ROUTES = ("qwen:self_consistency", "qwen:system2", "gemma:independent", "ministral:self_consistency", "ministral:cot5_cap40_n10")


def relation_dimension(spark: SparkSession) -> DataFrame:
    """Six rows, small enough to broadcast whatever the corpus."""
    return spark.createDataFrame(list(RELATIONS), "Relation string, kind string, nullable boolean, single boolean, never_empty boolean, theta_all double, theta_valid double")
