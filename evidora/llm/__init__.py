"""Training-data operators: each module has one operator and its query.

``registry`` gathers the queries; nothing outside this folder imports it except the entry
module, which tolerates its absence.
"""
