"""Column lists of the stored tables and of every JSON input. Nothing is ever inferred."""

from __future__ import annotations

TABLES = {
    "subjects": "subject_id long, name string",
    "books": "book_id long, subject_id long, year_value int",
    "options": "option_id long, book_id long, option_number int, exam_type string",
    "questions": "question_id long, option_id long, part string, question_number int, answer string",
    "images": "question_id long, object_key string, content_hash string, telegram_file_id string",
    "topics": "topic_id long, subject_id long, name string",
    "question_topics": "question_id long, topic_id long",
    "students": (
        "telegram_id long, telegram_name string, telegram_username string, full_name string, status string, "
        "created_at timestamp, handled_at timestamp, handled_by long"
    ),
    "test_sessions": (
        "session_id long, student_telegram_id long, option_id long, started_at timestamp, completed_at timestamp"
    ),
    "session_answers": (
        "session_id long, question_id long, student_answer string, correct_answer string, is_correct boolean, "
        "time_spent_seconds double, answered_at timestamp"
    ),
}

# Unique keys per table; the first is the primary key.
UNIQUE_KEYS = {
    "subjects": [["subject_id"], ["name"]],
    "books": [["book_id"], ["subject_id", "year_value"]],
    "options": [["option_id"], ["book_id", "option_number"]],
    "questions": [["question_id"], ["option_id", "part", "question_number"]],
    "images": [["question_id"], ["object_key"]],
    "topics": [["topic_id"], ["subject_id", "name"]],
    "question_topics": [["question_id", "topic_id"]],
    "students": [["telegram_id"]],
    "test_sessions": [["session_id"]],
    "session_answers": [["session_id", "question_id"]],
}

# (child, column, parent, parent column, what deleting the parent does to the child)
FOREIGN_KEYS = [
    ("books", "subject_id", "subjects", "subject_id", "cascade"),
    ("options", "book_id", "books", "book_id", "cascade"),
    ("questions", "option_id", "options", "option_id", "cascade"),
    ("images", "question_id", "questions", "question_id", "cascade"),
    ("topics", "subject_id", "subjects", "subject_id", "cascade"),
    ("question_topics", "question_id", "questions", "question_id", "cascade"),
    ("question_topics", "topic_id", "topics", "topic_id", "cascade"),
    ("students", "handled_by", "students", "telegram_id", "set null"),
    ("test_sessions", "student_telegram_id", "students", "telegram_id", "cascade"),
    ("test_sessions", "option_id", "options", "option_id", "restrict"),
    ("session_answers", "session_id", "test_sessions", "session_id", "cascade"),
    ("session_answers", "question_id", "questions", "question_id", "restrict"),
]

ANSWER_MAP = "map<string,map<string,string>>"
TOPIC_MAP = "map<string,map<string,map<string,array<string>>>>"
EXPORT = "image string, label array<struct<polygonlabels:array<string>,points:array<array<double>>>>"
TASKS = (
    "id long, data map<string,string>, is_labeled boolean, "
    "annotations array<struct<result:string,was_cancelled:boolean,ground_truth:boolean,lead_time:double,completed_by:string>>, "
    "predictions array<struct<score:double,model_version:string>>"
)
POLYGON_PX = "array<struct<x:int,y:int>>"
DETECTIONS = f"page string, ord int, label string, polygon_px {POLYGON_PX}, score double"
MARKER_TEXT = "page string, ord int, text string"
RECORDED = "version int, kind string, digest string, value string"
OUTPUTS = "version int, path string, digest string"
COMPLETED = "subject string, identifier string"
