"""Operators of a training-data pipeline: packing, licences, chats, quality, decontamination,
personal data, secrets, archives, language and near-duplicates.

Nothing outside this subpackage imports it.
"""
