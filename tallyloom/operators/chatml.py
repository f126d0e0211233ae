"""Prompts and chat text (ST1 to ST5, JS6, SRC8, FLT8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.aspects import converted, count, valid
from tallyloom.functions.jsonx import aspects_json, parse_gold
from tallyloom.functions.text import strip

#: The prompts that models were trained with.
SYSTEM = """Siz o'zbek tilida matnlardan aspektlarni va ularning hissiyotlarini aniqlash bo'yicha mutaxassissiz.

Berilgan matndan barcha aspekt terminlarini, ularning kategoriyalarini va hissiyot polaritesini (positive, negative, neutral) ajratib oling.

Javobni quyidagi Python dictionary formatida qaytaring:
{
    "aspects": [
        {
            "term": "aspekt termin",
            "category": "kategoriya",
            "polarity": "positive/negative/neutral"
        }
    ]
}"""
SYSTEM_ENGLISH = """You are an expert in extracting aspects and their sentiments from Uzbek text.

From the given text, extract all aspect terms, their categories, and sentiment polarity (positive, negative, neutral).

Return the response in the following Python dictionary format:
{
    "aspects": [
        {
            "term": "aspect term",
            "category": "category",
            "polarity": "positive/negative/neutral"
        }
    ]
}"""
ASK = ("Quyidagi o'zbek tilidagi matndan aspektlarni, kategoriyalarni va hissiyot polaritesini aniqlang:\n\nMatn: \"", '"')
ASK_ENGLISH = ('Extract aspects, categories, and sentiment polarities from the following Uzbek text:\n\nText: "', '"')
#: The prompts of the judge.
JUDGE_SYSTEM = """You are an expert evaluator for Aspect-Based Sentiment Analysis (ABSA) on Uzbek-language text.
Your task is to judge the quality of ABSA predictions made by a fine-tuned language model.

ABSA prediction format: a JSON with "aspects", where each aspect has:
- "term": the aspect phrase extracted from the text
- "category": aspect category (e.g., xizmat, ovqat, narx, muhit, boshqalar)
- "polarity": sentiment (positive, negative, neutral)

Score each dimension on a 1–5 scale where 5 is best.
Always return your evaluation as a valid JSON object — nothing else."""
JUDGE_RUBRIC = """== SCORING RUBRIC ==
1. completeness (1–5): Does the output capture ALL opinions/sentiments expressed in the text?
   5 = all opinions captured, 1 = most opinions missed
2. accuracy (1–5): Are the extracted aspect terms actually present or closely paraphrased in the text?
   5 = all terms present, 1 = mostly hallucinated terms
3. sentiment (1–5): Are the polarity labels correct for each aspect?
   5 = all correct, 1 = all wrong
4. relevance (1–5): Are the predicted categories appropriate and meaningful?
   5 = all appropriate, 1 = all irrelevant
5. overall (1–5): Overall annotation quality combining all dimensions.

Return ONLY a JSON object in this exact format (no markdown, no extra text):
{"completeness": <int>, "accuracy": <int>, "sentiment": <int>, "relevance": <int>, "overall": <int>, "explanation": "<1-2 sentence justification>"}"""
JUDGE_OPENING = "Evaluate the following ABSA prediction. There is no gold-standard reference — judge based on your understanding of the text."


def user_prompt(text: Column, english: bool = False) -> Column:
    before, after = ASK_ENGLISH if english else ASK
    return F.concat(F.lit(before), text, F.lit(after))


def turn(role: str, content: Column) -> Column:
    return F.concat(F.lit(f"<|im_start|>{role}\n"), content, F.lit("<|im_end|>"))


def training_text(text: Column, aspects: Column, system: str | None = SYSTEM, english: bool = False) -> Column:
    """Three turns. system None gives the word None, as one published preparation run has it."""
    return F.concat_ws("\n", turn("system", F.lit(str(system))), turn("user", user_prompt(text, english)), turn("assistant", aspects_json(aspects)))


def instruction_record(df: DataFrame, text: str = "text", aspects: str = "aspects", system: str = SYSTEM) -> DataFrame:
    return df.select(user_prompt(F.col(text)).alias("instruction"), F.col(text).alias("input"), aspects_json(F.col(aspects)).alias("output"), F.lit(system).alias("system"))


def inference_prompt(text: Column, english: bool = False) -> Column:
    system = SYSTEM_ENGLISH if english else SYSTEM
    return F.concat(turn("system", F.lit(system)), F.lit("\n"), turn("user", user_prompt(text, english)), F.lit("\n<|im_start|>assistant\n"))


def judge_prompt(text: Column, name: Column, category: Column, rating: Column, aspects: Column) -> Column:
    shown = lambda c, default: F.coalesce(c.cast("string"), F.lit(default))
    review = F.concat(F.lit('== REVIEW ==\nText: "'), text, F.lit('"\nBusiness: "'), shown(name, "Unknown"), F.lit('" (Category: '), shown(category, "Boshqa"), F.lit(")\nUser rating: "), shown(rating, "N/A"), F.lit("/5"))
    return F.concat_ws("\n\n", F.lit(JUDGE_OPENING), review, F.concat(F.lit("== MODEL PREDICTION ==\n"), aspects_json(aspects, 2)), F.lit(JUDGE_RUBRIC))


#: Where chat text holds a review, and the assistant's answer.
REVIEW, REVIEW_ENGLISH = r'(?s)Matn:\s*"(.+?)"', r'(?s)Text:\s*"(.+?)"'
ANSWER = r"(?s)<\|im_start\|>assistant\s*\n(.*?)(?:<\|im_end\|>|$)"


def review_text(chat: Column) -> Column:
    """The text between the first quote after the marker and the next quote, so it ends at a quote inside it."""
    first = F.regexp_extract(chat, REVIEW, 1)
    return strip(F.when(first != "", first).otherwise(F.regexp_extract(chat, REVIEW_ENGLISH, 1)))


def assistant_text(chat: Column) -> Column:
    return strip(F.regexp_extract(chat, ANSWER, 1))


def parse(df: DataFrame, chat: str = "text") -> DataFrame:
    """df with review_text and gold, the aspects of the assistant's JSON or none."""
    return df.withColumns({"review_text": review_text(F.col(chat)), "gold": parse_gold(assistant_text(F.col(chat)))["aspects"]})


def convert(df: DataFrame, terms: str = "aspect_terms", categories: str = "aspect_categories") -> DataFrame:
    """df with its valid aspects; rows without any go."""
    return df.withColumn("aspects", valid(converted(F.col(terms), F.col(categories)))).where(count(F.col("aspects")) > 0)
