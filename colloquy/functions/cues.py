"""Vocabulary that decides what a message says. The lists are fixed values; their order matters."""

from __future__ import annotations

#: Relation -> (confidence, window in characters or None, cues, in order of precedence).
RELATIONS: dict[str, tuple[float, int | None, list[str]]] = {
    "resolves": (
        0.9,
        None,
        ["fixed", "fix is", "resolved", "done", "deployed", "merged", "shipped", "released", "patched", "working now", "solved", "closed", "พร้อมแล้ว", "เสร็จแล้ว", "แก้แล้ว", "แก้เสร็จ", "fix แล้ว", "ขึ้นแล้ว", "deploy แล้ว", "merge แล้ว", "ปิดเคสแล้ว", "เรียบร้อย"],
    ),
    "blocked_by": (0.9, None, ["blocked", "waiting on", "waiting for", "depends on", "can't until", "cannot until", "still need", "รออยู่", "ยังรอ", "รอ api", "ติดที่", "ยังไม่มา", "ต้องรอ", "ยังทำไม่ได้"]),
    "duplicates": (0.9, None, ["same issue", "same problem", "same as", "duplicate", "already reported", "also seeing", "me too", "same here", "เหมือนกัน", "เจอเหมือนกัน", "ปัญหาเดียวกัน", "ซ้ำกับ", "อันเดียวกัน"]),
    "answers": (0.7, 48, ["yes", "no", "nope", "yep", "it's", "it is", "because", "the reason", "you need to", "you have to", "try", "here's", "here is", "correct", "right", "ใช่", "ไม่ใช่", "เพราะ", "ต้อง", "ลอง", "ได้เลย", "ตอบว่า", "อยู่ที่"]),
    "follows_up": (
        0.7,
        48,
        ["any update", "any news", "any progress", "any status", "status update", "status on", "what's the status", "how's it going", "still waiting", "still blocked", "still not", "still no", "still pending", "any eta", "eta on", "eta for", "eta?", "when will", "อัพเดท", "อัปเดท", "คืบหน้า", "ถึงไหน", "เมื่อไหร่", "เป็นไง", "ได้ยัง", "แล้วยัง", "เสร็จยัง"],
    ),
}
#: Fixed value: what a pair has that no cue types.
UNTYPED, UNTYPED_CONFIDENCE = "same_topic", 0.5
#: A question, in English or Thai.
QUESTION = r"\?|ไหม|มั้ย|หรือเปล่า|หรือยัง|ยังไง|เมื่อไหร่|อะไร|ทำไม"
#: Cues of a line that waits for something, and words that turn a sentence around.
WAITING = ["pending", "blocked", "waiting on", "waiting for", "on hold", "still waiting", "รออยู่", "ยังรอ", "ต้องรอ", "ยังไม่มา", "ยังทำไม่ได้", "ยังทำต่อไม่ได้", "ติดที่"]
CONTRAST = ["but", "however", "แต่"]
#: Subtypes of messages that say nothing about work.
IGNORED_SUBTYPES = ["channel_join", "channel_leave", "channel_topic", "channel_purpose", "channel_name", "channel_archive", "channel_unarchive", "group_join", "group_leave", "pinned_item", "unpinned_item", "bot_add", "bot_remove"]
#: Acknowledgements; a message of nothing else is dropped.
NOISE = [
    "ok", "okay", "okey", "oke", "k", "kk", "yes", "yep", "yeah", "y", "yy", "no", "nope", "noted", "ack", "same", "up", "lol", "haha", "hahaha", "hehe", "thanks", "thank", "thx", "ty", "tks", "nice", "good", "great", "cool",
    "โอเค", "โอเคครับ", "โอเคค่ะ", "ครับ", "คับ", "ครับผม", "ค่ะ", "คะ", "จ้า", "จ้าา", "จ๊ะ", "ได้", "ได้ครับ", "ได้ค่ะ", "รับทราบ", "โอ", "อ่อ", "อ๋อ", "เอ่อ", "งับ", "จร้า", "ขอบคุณ", "ขอบคุณครับ", "ขอบคุณค่ะ", "ขอบคุณมาก", "ขอบคุณมากครับ", "ๆ",
]
#: Words that keep a message however short it is.
TECHNICAL = [
    "be", "fe", "api", "apis", "uat", "prod", "production", "staging", "dev", "deploy", "deployed", "deployment", "merge", "merged", "mr", "pr", "commit", "branch", "rebase", "revert", "build", "ci", "cd", "pipeline", "release", "hotfix",
    "bug", "fix", "fixed", "error", "crash", "log", "logs", "db", "sql", "migration", "migrate", "index", "query", "cache", "endpoint", "token", "jwt", "auth", "login", "logout", "session", "sort", "sorting", "filter", "pagination", "paginate",
    "mock", "mocked", "test", "tests", "qa", "docker", "redis", "kafka", "s3", "frontend", "backend", "server", "client", "pending", "blocked", "done", "wip", "todo", "review", "rollback", "timeout", "latency", "schema",
]
#: Prefixes that look like ticket keys and are standards.
ACK_CHARS, ACK_TOPIC = 25, 10
