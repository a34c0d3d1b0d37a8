"""Fixed prompt texts, word lists and section titles of the question-answering jobs."""

from __future__ import annotations

# --- fixed values -------------------------------------------------------------------

IMPLEMENTATION_KEYWORDS = [
    "how is", "how does", "implement", "implementation", "function", "method", "class", "what does",
    "where is", "show me", "explain the code",
]
PLANNING_KEYWORDS = [
    "how to add", "how to implement", "how do i", "create new", "add feature", "extend", "modify",
    "refactor", "best way to", "architecture",
]

PROMPTS = {
    "implementation": """You are a code analysis expert. Answer the user's question about code implementation based on the provided context.

Context from codebase:
{context}

User Question: {question}

Instructions:
1. Answer based on the provided code context
2. Include specific file references and line numbers when available
3. Explain the implementation details clearly
4. If the context is insufficient, say so honestly

Answer:""",
    "planning": """You are a software architect. Help the user plan features or changes based on the existing codebase structure.

Context from codebase:
{context}

User Question: {question}

Instructions:
1. Analyze the existing code structure
2. Suggest implementation approach
3. Identify potential impacts on existing code
4. Recommend best practices
5. List files that may need modification

Answer:""",
    "hybrid": """You are a senior developer helping to understand and plan code changes. Combine implementation details with architectural guidance.

Context from codebase:
{context}

User Question: {question}

Instructions:
1. Explain the current implementation
2. Provide architectural context
3. Suggest improvements or changes
4. Include specific code references
5. Consider maintainability and scalability

Answer:""",
    "freeform": """You are a helpful AI assistant. Have a natural conversation with the user.

User Message: {question}

Instructions:
1. Respond naturally and helpfully
2. Be concise but thorough
3. If the user asks about code, provide general guidance
4. Be friendly and professional

Answer:""",
}
NO_CONTEXT = "No relevant code context found."

CITATION_LINK = r"\[([^\]:]+):(\d+)(?:-(\d+))?\]\([^\)]+\)"
CITATION_BARE = r"(?:^|\s)([^\s:]+\.py):(\d+)(?::(\d+))?(?:\s|$)"
CODE_BLOCK = r"(?s)```(\w+)?\n(.*?)```"
SOURCES_TITLE = "\n\n**Sources:**\n"

TRUNCATED = "\n... (内容过长，已截断)"
NEEDS_BY_MODE = {
    "full_context": ["readme", "summary", "code", "structure", "tech_stack"],
    "code_only": ["code"],
    "documentation": ["readme", "summary"],
    "default": ["readme", "summary", "code"],
}
SECTION_TITLES = {
    "readme": "=== README 文档 ===",
    "summary": "=== 项目摘要 ===",
    "structure": "=== 项目结构 ===",
    "tech_stack": "=== 技术栈 ===",
    "code": "=== 相关代码 ===",
}
