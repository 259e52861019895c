"""Prompts for profile models, in our own words, and the fields that answers have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Field and what its value looks like.
FIELDS: dict[str, str] = {
    "full_name": "text",
    "gender": "Male or Female",
    "birthdate": "YYYY-MM-DD",
    "race_ethnicity": "text",
    "education": "list of {degree, institution, year}",
    "religion": "text",
    "committee_roles": "list of text",
}
_CONTRACT = "Answer with one JSON object and nothing else. Its keys: " + ", ".join(f"{k} ({v})" for k, v in FIELDS.items()) + ". Use null for whatever the text does not say."

PROMPTS: dict[str, str] = {
    "direct": f"Read the biography below and fill in the profile of the person it is about. {_CONTRACT}\n\nBiography:\n{{text}}",
    "pseudocode": f"Carry out these steps.\n1. person := whom the text is about\n2. for each key: evidence := the words of the text that state it\n3. if there is no evidence: value := null, else value := evidence in the key's form\n4. return the object\n{_CONTRACT}\n\ntext = <{{text}}>",
    "icl": f'{_CONTRACT}\n\nExample text: Ada Poe, born 2 May 1960, holds a B.A. from Oak College (1982). She sits on the Budget Committee.\nExample answer: {{"full_name": "Ada Poe", "gender": "Female", "birthdate": "1960-05-02", "race_ethnicity": null, "education": [{{"degree": "BA", "institution": "Oak College", "year": 1982}}], "religion": null, "committee_roles": ["Budget Committee"]}}\n\nText: {{text}}\nAnswer:',
}
EDUCATION_PROMPT = "List the degrees of the person described below, one in a line, as degree|institution|year. Leave a part empty if the text does not say it; write nothing else.\n\n{text}"


def prompt_table(spark: SparkSession, styles: list[str] | None = None) -> DataFrame:
    """(style, prompt), as ask() takes it."""
    return spark.createDataFrame([(k, v) for k, v in PROMPTS.items() if styles is None or k in styles], "style string, prompt string")
