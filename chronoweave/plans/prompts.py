"""Prompts for models, as columns. The wording is ours; the fields are those that every backend needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import text
from chronoweave.functions.scores import top_k
from chronoweave.plans.spec import STYLES

_LIST = {"en": "Answer with a Python list of strings only.", "vi": "Chỉ trả lời bằng một danh sách Python gồm các chuỗi."}
_EXTRACT = {
    "entities": {"en": "Name the people, places and organisations in the question. %s\nQuestion: {question}", "vi": "Nêu tên tiếng Anh của người, nơi và tổ chức trong câu hỏi. %s\nCâu hỏi: {question}"},
    "relation": {"en": "Which one of these relations does the question ask about? Answer with its name only.\nRelations: {relations}\nEntities: {entities}\nQuestion: {question}", "vi": "Câu hỏi nói về quan hệ nào dưới đây? Chỉ trả lời tên quan hệ.\nQuan hệ: {relations}\nThực thể: {entities}\nCâu hỏi: {question}"},
    "main": {"en": "Which entity is the answer connected with: the subject, or the object if the question asks for the subject? Answer with its name only.\nEntities: {entities}\nQuestion: {question}", "vi": "Đáp án gắn với thực thể nào: chủ ngữ, hay tân ngữ nếu câu hỏi hỏi về chủ ngữ? Chỉ trả lời tên thực thể.\nThực thể: {entities}\nCâu hỏi: {question}"},
}
_REASON = {
    "paper": {"en": "Use only the facts [subject, relation, object, date] to answer. %s An empty list means that no fact answers.", "vi": "Chỉ dùng các sự kiện [chủ thể, quan hệ, đối tượng, ngày] để trả lời. %s Danh sách rỗng nghĩa là không sự kiện nào trả lời được."},
    "strict": {"en": "Use only the facts [subject, relation, object, date] to answer, and only those of the relation asked for. Copy names and dates exactly; shorten a date only if a year or month is asked for. Never answer with the event that the question refers to. %s", "vi": "Chỉ dùng các sự kiện [chủ thể, quan hệ, đối tượng, ngày] có đúng quan hệ được hỏi. Chép nguyên văn tên và ngày; chỉ rút gọn ngày khi câu hỏi hỏi năm hoặc tháng. Không trả lời bằng sự kiện mốc trong câu hỏi. %s"},
}
_FIELDS = "\nQuestion: {question}\nType: {answer_type}\nAt most: {topk}\nEntities: {entities}\nFacts:\n{facts}"
_RETRY = {"en": "\nThe list was empty, which is never right. Give the most likely answer from the facts.", "vi": "\nDanh sách vừa rồi rỗng, không bao giờ đúng. Hãy đưa ra đáp án hợp lý nhất từ các sự kiện."}


def _language(lang: str) -> str:
    return "vi" if lang == "vi" else "en"


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with its {fields} filled; each field's text is taken as it is."""
    out, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(head), F.coalesce(values[name], F.lit(""))]
    return F.concat(*out, F.lit(rest))


def extraction(kind: str, lang: str, values: dict[str, Column]) -> Column:
    """Prompt for entities, relation or main entity; `relations` should be the sorted list, so that equal requests have equal keys."""
    template = _EXTRACT[kind][_language(lang)]
    return fill(template.replace("%s", _LIST[_language(lang)]), values)


def template(style: str, lang: str) -> str:
    """The reasoning prompt of a style; an unknown style raises, an unknown language is English."""
    if style not in STYLES:
        raise ValueError(f"unknown prompt style {style!r}; known are {STYLES}")
    return _REASON[style][_language(lang)].replace("%s", _LIST[_language(lang)]) + _FIELDS


def retry_suffix(lang: str) -> str:
    return _RETRY[_language(lang)]


def sorted_list(values: DataFrame, column: str) -> DataFrame:
    """One row: a vocabulary as a sorted, bracketed list. For vocabularies that a prompt can hold."""
    return values.agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_set(column)), ", "), F.lit("]")).alias("list"))


def evidence(chain: DataFrame) -> DataFrame:
    """(qid, facts): a chain's facts as text, one a line, in order of rank."""
    line = F.struct("rank", text.fact_tuple(F.col("s"), F.col("p"), F.col("o"), F.col("ts")).alias("line"))
    return chain.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("facts"))


def grounded_text(grounded: DataFrame) -> DataFrame:
    """(qid, entities): grounded entities in order, or `None`."""
    names = F.array_join(F.sort_array(F.collect_set("entity")), ", ")
    return grounded.groupBy("qid").agg(F.when(names == "", "None").otherwise(names).alias("entities"))


def reasoning(questions: DataFrame, chain: DataFrame, grounded: DataFrame, style: str, lang: str, question: str = "question") -> DataFrame:
    """(qid, prompt) of every question."""
    rows = questions.join(evidence(chain), "qid", "left").join(grounded_text(grounded), "qid", "left")
    values = {"question": F.col(question), "answer_type": F.col("answer_type"), "topk": top_k(F.col("qlabel")).cast("string"), "entities": F.coalesce("entities", F.lit("None")), "facts": F.col("facts")}
    return rows.select("qid", fill(template(style, lang), values).alias("prompt"))
