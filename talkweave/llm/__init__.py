"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it; its queries are listed in
``talkweave.llm.queries``.
"""
