"""Reports: contract funnel, fleet status, counters, costs, contract profiles, model inputs."""
