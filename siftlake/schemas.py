"""Column names and types of the search-message, event-log, run and launch tables."""

from __future__ import annotations

MESSAGE = (
    "seed_id string, solution_features array<int>, rcl_features array<int>, neighborhood string, enabled_local_searches array<string>, "
    "neighborhood_max_iterations int, bit_flip_max_iterations int, iwss_max_iterations int, iwssr_max_iterations int, iteration_neighborhood int, "
    "classifier string, f1_score double, rcl_algorithm string, cpu_usage double, memory_usage double, memory_usage_percent double, accuracy double, "
    "precision double, recall double, local_search string, status string, running_time_ms long, iteration_local_search int, "
    "training_file_name string, testing_file_name string, use_training_cache boolean"
)

#: The event log that the monitoring operators read; one row for each message received.
EVENT = (
    "event_id long, seed_id string, request_id string, topic string, event_type string, stage string, status string, created_at timestamp, score double, "
    "cpu_usage double, memory_usage double, memory_usage_percent double, rcl_algorithm string, local_search string, neighborhood string, "
    "iteration_neighborhood int, training_file_name string, testing_file_name string, solution_features array<int>, rcl_features array<int>, classifier string"
)

LAUNCH = (
    "launch_id long, request_id string, requested_by long, requested_at timestamp, started_at timestamp, algorithms array<string>, training_file_name string, "
    "testing_file_name string, classifier string, executions int, generations int, state string"
)

#: Topics of the search, and the names of searches, strategies and event kinds.
INITIAL, RESTART, SOLUTIONS, PROGRESS, BEST = ("INITIAL_SOLUTION_TOPIC", "NEIGHBORHOOD_RESTART_TOPIC", "SOLUTIONS_TOPIC", "LOCAL_SEARCH_PROGRESS_TOPIC", "BEST_SOLUTION_TOPIC")
TOPICS = (INITIAL, RESTART, SOLUTIONS, PROGRESS, BEST)
LOCAL_SEARCHES = ("BIT_FLIP", "IWSS", "IWSSR")
STRATEGIES = ("VND", "RVND")
SNAPSHOT_EVENTS = ("kafka.update", "kafka.progress")
GATEWAY_EVENT, GATEWAY_TOPIC = "gateway.dispatch", "API_GATEWAY"
UNKNOWN, NO_FILE, NO_TOPIC = "Unknown", "--", "UNSPECIFIED"
