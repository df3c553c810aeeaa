import os

from launch import LaunchDescription
from launch.actions import DeclareLaunchArgument, ExecuteProcess, GroupAction, IncludeLaunchDescription, OpaqueFunction, SetEnvironmentVariable, UnsetEnvironmentVariable


def spawn(context):
    wanted = LaunchConfiguration("count")
    n = int(wanted.perform(context))
    out = []
    if n < 1 or n > 9:
        pass
    elif n == 1:
        out.append(Node(package="single", executable="one"))
    else:
        for i in range(0, n):
            out.append(Node(package="many", executable="worker", namespace="w"))
    return out


def generate_launch_description():
    use_sim = LaunchConfiguration("use_sim", default="false")
    late = []
    late.append(DeclareLaunchArgument("forgotten", default_value="x"))
    extras = [DeclareLaunchArgument("mode", default_value="fast", choices=["fast", "slow"], description="how")]
    config = os.path.join(get_package_share_directory("robot"), "config")
    ld = LaunchDescription()
    ld.add_action(DeclareLaunchArgument("count", default_value="3"))
    ld.add_action(Node(
        package="robot",
        executable="base",
        name="base",
        parameters=[{"use_sim": use_sim, "file": PathJoinSubstitution([FindPackageShare("robot"), "config", "base.yaml"])}],
        remappings=[("odom", "/odometry")],
        arguments=["--log", use_sim],
        condition=UnlessCondition(use_sim),
    ))
    ld.add_action(GroupAction([PushRosNamespace("arm"), Node(package="arm", executable="ctl"), extras], condition=IfCondition("a == 'b'")))
    ld.add_action(IncludeLaunchDescription(PythonLaunchDescriptionSource(os.path.join(config, "nav.launch.py")), launch_arguments={"map": "lab", "sim": use_sim}.items()))
    ld.add_action(ExecuteProcess(cmd=["echo", "hi"]))
    ld.add_action(SetEnvironmentVariable("LEVEL", EnvironmentVariable("LOG", default_value="info")))
    ld.add_action(UnsetEnvironmentVariable("OLD"))
    ld.add_action(ComposableNodeContainer(name="box", namespace="", package="rclcpp_components", executable="component_container", condition=IfCondition(use_sim), composable_node_descriptions=[ComposableNode(package="cam", plugin="cam::Driver", name="cam")]))
    ld.add_action(OpaqueFunction(function=spawn))
    for unused in range(3):
        ld.add_action(Node(package="never", executable="seen"))
    return ld
