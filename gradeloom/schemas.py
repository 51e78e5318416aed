"""Schemas of the documents that are read and written."""

QUESTION = (
    "question string, subject string, category string, expected_template string, "
    "choices array<string>, answer int, original_split string"
)

QUESTION_DOCUMENT = (
    "metadata struct<total_questions:bigint, split:string, generated_at:string, source:string, "
    "split_strategy:string, embedding_dim:int, first_question_id:bigint>, "
    "questions array<struct<question_id:bigint, question:string, subject:string, category:string, expected_template:string, "
    "choices:array<string>, answer:int, original_split:string>>, "
    "embeddings array<array<float>>"
)

RESPONSE = (
    "struct<question_id:bigint, question:string, strategy:string, template:string, provider:string, "
    "response:string, success:boolean, error:string, attempts:int, input_tokens:int, output_tokens:int>"
)

RESULTS_DOCUMENT = f"map<string, map<string, array<{RESPONSE}>>>"
BATCH_RESPONSE = RESPONSE[:-1] + ", choices:array<string>, answer:int, category:string, total_tokens:int>"
BATCH_RESULTS_DOCUMENT = f"map<string, array<{BATCH_RESPONSE}>>"

RESPONSE_ROW = (
    "question_id bigint, question string, strategy string, template string, provider string, "
    "response string, success boolean, error string, attempts int, input_tokens int, output_tokens int"
)

PREDICTION_ROW = "question_id bigint, question string, ground_truth string, baseline string, simple_neural string, roberta string"

BATCH_RESULT_LINE = (
    "custom_id string, response struct<status_code:int, body:struct<"
    "choices:array<struct<message:struct<content:string>>>, "
    "usage:struct<prompt_tokens:int, completion_tokens:int, total_tokens:int>>>"
)

CACHE_ENTRY = (
    "question_id bigint, question string, provider string, timestamp timestamp, response string, "
    "success boolean, error string, attempts int"
)

PROVIDER_DOCUMENT = (
    "provider string, timestamp string, total_questions bigint, successful bigint, failed bigint, "
    "responses array<struct<question_id:bigint, question:string, response:string, success:boolean, "
    "error:string, attempts:int>>"
)

SAVED_QUESTIONS = "timestamp string, total_questions bigint, questions array<string>"

TRACKER = (
    "created_at string, num_questions bigint, provider string, status string, "
    "strategies map<string, struct<batch_id:string, file_id:string, status:string, created_at:bigint, "
    "request_count:bigint, jsonl_file:string, output_file_id:string>>"
)
