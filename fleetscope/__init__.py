"""fleetscope: launch-program and publish/subscribe analytics on Spark."""
