"""Table schemas, as DDL."""

RECORDS = "source string, community string, id string, parent_id string, post_id string, author string, created_at string, title string, body string, score long"
THREADS = (
    "thread_id string, community string, title string, post_author string, post_created_at string, post_score long, post_body string, comment_count long, "
    "best_answer_id string, best_answer_author string, best_answer_score long, best_answer_body string, conversation_turns long, conversation_json string, "
    "discussion_transcript string, total_word_count long, total_char_count long"
)
DECISIONS = "is_rag_related double, technical_quality_score double, taxonomy_topic string, topic_confidence double, curation_passed boolean"
CURATED = f"{THREADS}, {DECISIONS}"
PROMPTS = "thread_id string, prompt array<struct<role:string,content:string>>, taxonomy_topic string, reference_answer string, title string"
BENCHMARK = (
    "id string, category string, difficulty string, test_type string, question string, expected_concepts array<string>, reference_reasoning string, "
    "scoring_rubric struct<correctness:string,grounding:string,tradeoffs:string>"
)
