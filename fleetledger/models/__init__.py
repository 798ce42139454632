"""Cost-driver models: sufficient statistics over the cluster, small solves, coefficient effects."""
