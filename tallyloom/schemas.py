"""Explicit schemas of the review-analytics tables; an absent key is null."""

from __future__ import annotations

from pyspark.sql import types as T

POLARITIES = ("positive", "negative", "neutral")
SCORES = ("completeness", "accuracy", "sentiment", "relevance", "overall")
#: The business category of reviews without one, and where annotations come from.
NO_CATEGORY = "Boshqa"
ANNOTATION_SOURCE = "model"

KINDS = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def struct(**fields: str | T.DataType) -> T.StructType:
    """A struct of nullable fields, by the names of simple types or types; it needs no session."""
    return T.StructType([T.StructField(k, KINDS[v] if isinstance(v, str) else v) for k, v in fields.items()])


ASPECT = struct(term="string", category="string", polarity="string")
ASPECTS = T.ArrayType(ASPECT)
RAW_REVIEW = struct(review_text="string", object_name="string", rating_value="double", reviewer_name="string", review_date="string", source_url="string")
SEMEVAL = struct(sentence_id="string", text="string", aspect_terms=T.ArrayType(struct(term="string", polarity="string", **{"from": "int", "to": "int"})), aspect_categories=T.ArrayType(struct(category="string", polarity="string")))
ANNOTATION = struct(review_id="string", text="string", business_name="string", business_category="string", user_rating="int", aspects=ASPECTS, num_aspects="int", annotation_source="string", parse_success="boolean", raw_output="string")
JUDGE_SCORES = struct(**dict.fromkeys(SCORES, "int"), explanation="string")
JUDGE_RESULT = T.StructType([*[f for f in ANNOTATION if f.name not in ("annotation_source", "parse_success", "raw_output")], T.StructField("judge_scores", JUDGE_SCORES), T.StructField("judge_raw", T.StringType())])
CATEGORY = struct(object_name="string", business_category="string")
RULE = struct(category="string", keywords=T.ArrayType(T.StringType()))
TRAIN_LOG = struct(step="int", epoch="double", timestamp="string", **dict.fromkeys(("wall_time_s", "train_loss", "learning_rate", "grad_norm", "gpu_mem_allocated_gb", "gpu_mem_reserved_gb", "eval_loss", "eval_runtime", "eval_samples_per_second", "eval_steps_per_second", "train_runtime", "train_samples_per_second", "train_steps_per_second", "total_flos"), "double"))
