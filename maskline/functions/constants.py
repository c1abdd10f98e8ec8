"""Fixed values that results depend on."""

from __future__ import annotations

# The identifier categories, in their order.
CODES = (
    "01_NAME",
    "02_GEOGRAPHIC_SUBDIVISION",
    "03_DATE",
    "04_AGE_OVER_89",
    "05_TELEPHONE_NUMBER",
    "06_FAX_NUMBER",
    "07_EMAIL_ADDRESS",
    "08_SOCIAL_SECURITY_NUMBER",
    "09_MEDICAL_RECORD_NUMBER",
    "10_HEALTH_PLAN_BENEFICIARY_NUMBER",
    "11_ACCOUNT_NUMBER",
    "12_CERTIFICATE_OR_LICENSE_NUMBER",
    "13_VEHICLE_IDENTIFIER_OR_SERIAL_NUMBER",
    "14_DEVICE_IDENTIFIER_OR_SERIAL_NUMBER",
    "15_WEB_URL",
    "16_IP_ADDRESS",
    "17_BIOMETRIC_IDENTIFIER",
    "18_FULL_FACE_PHOTO_OR_OTHER_UNIQUE_IDENTIFIER",
)

# Marker of a category; all but the last are the code's words.
MARKERS = {c: f"[{c[3:]}]" for c in CODES[:-1]} | {CODES[-1]: "[OTHER_UNIQUE_IDENTIFIER]"}

# Neutral marker, window and overlap in codepoints, tolerance of relaxed matches.
NEUTRAL = "[PHI]"
WINDOW, OVERLAP = 3500, 400
TOLERANCE = 2
PREDICTIONS_VERSION = "resolved-predictions-v1"

# Decoding settings of a served model.
DECODING = {"temperature": 0, "seed": 42, "reasoning_effort": "low"}

# The offline extractor's patterns, Unicode-aware as Java spells it.
PATTERNS = (
    ("07_EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("05_TELEPHONE_NUMBER", r"(?U)\(?\d{3}\)?[ -]\d{3}-\d{4}"),
    ("03_DATE", r"(?U)\b\d{1,2}/\d{1,2}/\d{4}\b"),
    ("03_DATE", r"(?U)\b\d{4}-\d{2}-\d{2}\b"),
    ("03_DATE", r"(?U)\b(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}\b"),
    ("09_MEDICAL_RECORD_NUMBER", r"(?U)(?<=MRN:\s)[A-Z0-9-]{4,}"),
    ("04_AGE_OVER_89", r"(?U)\b(?:9\d|1\d\d)-year-old\b"),
)

PASSES = ("pass1", "cumulative_pass2")
COHORTS = ("all_expected", "operational_complete")

# Bootstrap settings.
RESAMPLES, BOOTSTRAP_SEED, ALPHA = 10_000, 20260801, 0.05

# Columns of the long result table, in order.
METRICS = """
model_id hf_link hf_gguf_repo developer family params_total_B params_active_B moe is_medical is_reasoning
quant n_docs doc_provenance pass surface cohort phi_type
n_notes doc_chars_total gt_phi_chars pred_phi_chars gt_span_count pred_span_count
char_tp char_fp char_fn char_tn char_recall char_precision char_f1 char_specificity
over_redaction_rate residual_phi_chars residual_phi_char_rate
char_recall_typematched char_precision_typematched char_f1_typematched
any_span_tp any_span_recall full_span_tp full_span_recall
strict_span_tp strict_span_recall strict_span_precision strict_span_f1
relaxed_span_tp relaxed_span_recall relaxed_span_precision relaxed_span_f1
zero_residual_notes zero_residual_note_rate notes_with_leak notes_with_leak_rate
mean_residual_per_note median_residual_per_note max_residual_per_note
expected_requests usable_requests usable_rate json_valid_requests json_valid_rate finish_stop_rate
prompt_tokens completion_tokens
char_recall_macro char_precision_macro char_f1_macro strict_span_recall_macro relaxed_span_recall_macro
""".split()

# The study's checkpoints, in order: id, display name, developer, family, total and active
# parameters in billions, mixture of experts, medical, quantization, size in GB, repository.
CHECKPOINTS = """
gemma-4-31B-it|Gemma-4 31B|Google|Gemma-4|30.7||false|false|Q5_K_M|21.66|unsloth/gemma-4-31B-it-GGUF
gemma-4-12b-it|Gemma-4 12B|Google|Gemma-4|12.0||false|false|Q8_0|12.67|unsloth/gemma-4-12b-it-GGUF
Mistral-Small-3.2-24B-Instruct-2506|Mistral-Small 24B|Mistral AI|Mistral-Small|24.0||false|false|Q5_K_M|16.76|unsloth/Mistral-Small-3.2-24B-Instruct-2506-GGUF
gemma-4-E4B-it|Gemma-4 E4B|Google|Gemma-4|4.5||false|false|Q8_0|8.19|unsloth/gemma-4-E4B-it-GGUF
gemma-4-26B-A4B-it|Gemma-4 26B-A4B|Google|Gemma-4|25.2|3.8|true|false|UD-Q5_K_M|21.15|unsloth/gemma-4-26B-A4B-it-GGUF
Ministral-3-14B-Instruct-2512|Ministral-3 14B|Mistral AI|Ministral-3|14.0||false|false|Q6_K|11.09|unsloth/Ministral-3-14B-Instruct-2512-GGUF
gemma-4-E2B-it|Gemma-4 E2B|Google|Gemma-4|2.3||false|false|BF16|9.31|google/gemma-4-E2B-it
gemma-3-27b-it|Gemma-3 27B|Google|Gemma-3|27.0||false|false|Q5_K_M|19.27|unsloth/gemma-3-27b-it-GGUF
phi-4|Phi-4 14B|Microsoft|Phi-4|14.0||false|false|Q6_K|12.03|unsloth/phi-4-GGUF
medgemma-27b-text-it|MedGemma 27B|Google|MedGemma|27.0||false|true|Q5_K_M|19.27|unsloth/medgemma-27b-text-it-GGUF
granite-4.1-30b|Granite-4.1 30B|IBM|Granite-4.1|30.0||false|false|Q5_K_M|20.49|ibm-granite/granite-4.1-30b-GGUF
granite-4.1-8b|Granite-4.1 8B|IBM|Granite-4.1|8.0||false|false|Q6_K|7.22|ibm-granite/granite-4.1-8b-GGUF
gemma-3-4b-it|Gemma-3 4B|Google|Gemma-3|4.0||false|false|Q8_0|4.13|unsloth/gemma-3-4b-it-GGUF
Meta-Llama-3.1-8B-Instruct|Llama-3.1 8B|Meta|Llama-3.1|8.0||false|false|Q6_K|6.60|bartowski/Meta-Llama-3.1-8B-Instruct-GGUF
Olmo-3-7B-Instruct|OLMo-3 7B|Ai2|OLMo-3|7.0||false|false|Q8_0|7.76|lmstudio-community/Olmo-3-7B-Instruct-GGUF
gemma-3-1b-it|Gemma-3 1B|Google|Gemma-3|1.0||false|false|Q8_0|1.07|ggml-org/gemma-3-1b-it-GGUF
medgemma-1.5-4b-it|MedGemma-1.5 4B|Google|MedGemma-1.5|4.0||false|true|Q8_0|4.13|unsloth/medgemma-1.5-4b-it-GGUF
"""
