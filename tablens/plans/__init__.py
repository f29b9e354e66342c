"""Whole analyses built from the operators."""

from .dataset import Dataset
from .profile import Profile, profile
from .rules import auto_plan, plan_table
from .tasks import Task, run_task, run_tasks

__all__ = ["Dataset", "Profile", "Task", "auto_plan", "plan_table", "profile", "run_task", "run_tasks"]
