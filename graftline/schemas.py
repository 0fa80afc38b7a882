"""Fixed values and schemas of the data model."""

from pyspark.sql import types as T

# The leaf sentinel and its title, the markers of serialised texts, the id of
# mentions without a concept.
NULL_ID = "SCTID_NULL"
NULL_TITLE = "NULL"
MENTION_START, MENTION_END = "[Ms]", "[Me]"
PARENT_TAG, CHILD_TAG, NULL_TAG = "[P-TAG]", "[C-TAG]", "[NULL]"
OUT_OF_KB = "SCTID-less"

# Defaults of the retrieval and ranking steps.
SEED = 42
SPLIT_RATIOS = (0.70, 0.15, 0.15)
BM25_K1, BM25_B = 1.5, 0.75
TOP_CONCEPTS = 50
K_VALUES = (1, 5, 10, 50)
MARGIN = 0.2
HARD_NEGATIVES, NEGATIVE_POOL = 4, 100
LLM_MAX_CANDIDATES = 50
MAX_CONTEXT_WORDS, MAX_CONTEXT_CHARS = 64, 1000


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


ENTITY = _strings("idx", "title", "entity", "text", "synonyms", "parents_idx", "children_idx", "parents", "children")
EDGE = T.StructType(_strings("parent_idx", "child_idx", "parent", "child").fields + [T.StructField("degree", T.IntegerType())])
MENTION = _strings("mention", "context_left", "context_right", "parents_concept", "children_concept", "parents-children_concept",
                   "label_concept", "label_concept_ori", "label_concept_UMLS", "label_title", "label")
EDGE_PAIR = _strings("mention", "context_left", "context_right", "parent_concept", "child_concept", "label_concept", "label_concept_ori",
                     "label_concept_UMLS", "entity_label_title", "entity_label")
DOCUMENT = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("entities", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])))])
REPLY = "valid boolean, class string, confidence double, relations array<struct<head:string,relation:string,tail:string>>"
CLASSES = "classes map<string,struct<parent:string>>, entity_type_mapping map<string,string>"
