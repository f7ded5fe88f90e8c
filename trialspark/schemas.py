"""Table schemas and the label values that results must share with existing analyses."""

from __future__ import annotations

from pyspark.sql import types as T


KINDS = {
    "string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(),
}


def struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in fields.items()])


EVENT_LOG = struct(
    time_received="bigint", ip_md5="string", controller="string", order="bigint",
    element_no="string", condition="string", latin_square_group="string",
    element_type="string", element_name="string", parameter="string", value="string",
    event_time="bigint", item="string", word="string", target_response="string",
    args_group="string", sentence_type="string", sentence="string", adverb="string",
    seen_in_training="string", template="string", comments="string",
)

STIMULI = struct(
    item="bigint", sentence="string", sentence_type="string", group="string",
    adverb="string", word="string", seen_in_training="string", target_response="string",
)
TRAINING = struct(
    item="string", sentence="string", sentence_type="string", group="string",
    word="string", target_response="string", adverb="string",
)
FILLERS = struct(
    item="bigint", sentence="string", sentence_type="string", filler_group="string",
    **{f"word_{i}": "string" for i in range(12)}, adverb="string",
)
PRACTICE = struct(
    item="string", sentence="string", sentence_type="string", group="string",
    **{f"word_{i}": "string" for i in range(8)}, adverb="string",
)
ITEMS = {"stimuli": STIMULI, "training": TRAINING, "fillers": FILLERS, "practice": PRACTICE}

MODEL_SCORES = struct(
    model_id="string", model_name="string", random_seed="bigint", eval_data="string",
    token="string", token_type="string", arg_type="string", ratio_name="string",
    odds_ratio="double", odds_ratio_pre_post_difference="double", max_epochs="bigint",
    mask_added_tokens="boolean", sentence="string", sentence_type="string",
    args_group="string",
)
COSSIMS = struct(
    model_id="string", model_name="string", token="string", target_group="string",
    correction="string", eval_epoch="bigint", epoch_criteria="string", cossim="double",
)
TRIALS = struct(
    subject="bigint", condition="string", training="string", item="string", word="string",
    target_response="string", args_group="string", sentence_type="string",
    sentence="string", adverb="string", seen_in_training="string", data_source="string",
    mouse="string", response="string", log_rt="double", correct="boolean",
    correct_pre_training="boolean", voice="string", mask_added_tokens="string",
    stop_at="string", model_id="string",
)

# Labels, level orders and limits that results are compared on.
HUMAN = "human"
MODELS = ["BERT", "ModernBERT Base", "ModernBERT Large"]
UNMASKED = "Don't mask blork"
MASKED = "Mask blork"
CONVERGENCE = "convergence"
EARLY_STOP = "260 epochs"
TRAINING_LABEL = "SVO+OSV"
EXPERIMENTAL_EVAL = "syn_blorked_SVO-OSV_for_human_exp"
ACTIVE = "SVO active"
PASSIVE = "OVS passive"
REVERSED = "OSV active"
SUBJECT_TARGET = "Subject target"
OBJECT_TARGET = "Object target"
TRAINING_STRUCTURE = "perfect transitive"
ADVERBS = ["always", "often", "usually", "typically"]
MS_PER_WORD = 325
MAX_BREAK_MS = 15 * 60 * 1000

LEVELS = {
    "target_response": [SUBJECT_TARGET, OBJECT_TARGET],
    "args_group": [
        "buildings+vehicles args", "break args", "buy args", "drink args", "eat args",
        "read args", "regret args",
    ],
    "sentence_type": [
        "perfect transitive",
        "raising perfect transitive",
        "cleft subject perfect transitive",
        "neg perfect transitive",
        "cleft subject raising perfect transitive",
        "perfect passive",
        "raising perfect passive",
        "cleft subject perfect passive",
        "neg perfect passive",
        "cleft subject raising perfect passive",
    ],
    "voice": [ACTIVE, PASSIVE],
    "data_source": [HUMAN, *MODELS],
    "mask_added_tokens": [UNMASKED],
    "stop_at": [CONVERGENCE],
}

# Display order of the stacked labels that ``metrics.pre_post_stack`` writes to ``data_source``.
STAGES = ["People", *(f"{m} ({s})" for m in MODELS for s in ("fine-tuned", "pre-fine-tuning"))]

SOURCE_SETS = {
    "bert": [HUMAN, "BERT"],
    "modernbert_base": [HUMAN, "ModernBERT Base"],
    "modernbert_large": [HUMAN, "ModernBERT Large"],
}

# Words of the eating fillers and their drinking counterparts.
EAT_TO_DRINK = {
    "customer": "girl", "person": "man", "guest": "boy", "child": "woman",
    "patient": "person", "king": "customer", "pizza": "water", "orange": "milk",
    "steak": "wine", "bread": "beer", "sandwich": "coffee", "dessert": "tea",
}

# Tuning tokens that stand in for words one model family lacks.
TOKEN_SWAPS = {"chalk": "pearl", "crab": "lobster"}

# Training blocks that count towards the criterion, in the order they run.
TRAINING_BLOCKS = [
    "trial_train_rep01", "trial_train_rep1", "trial_train_rep2", "trial_train_rep3",
    "trial_train_rep4",
]
